"""Quality rules: text statistics in DataFrame functions, and a decision list learned from labelled ones.

Sequential covering grows one conjunction of thresholds at a time on two thirds of what is left, by FOIL's
gain, prunes its last conditions on the other third, and takes it if it is precise enough on both. The
rules become one ordered conditional expression of Spark's.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
#: Counts that the statistics add to a table; they replace columns of these names.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_upper", "n_stops")


def _once(column: Column) -> Column:
    """The same value, computed once per row: what isn't deterministic the optimizer copies neither into the lambdas that use it nor into a filter further up."""
    return F.when(F.monotonically_increasing_id() >= 0, column)


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the columns of COUNTS, all long. Null text counts as empty.

    Each row's numbers come from its own text only, so there is no shuffle, and copies, ties and null
    keys need no rule. n_repeat_words counts the words inside three-word windows that the text has twice or more.
    """
    own = [c for c in df.columns if c not in COUNTS]
    keep = [F.col(f"`{c}`") for c in own]
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    has_word = lambda line: line.rlike(r"[^\x20\x09-\x0D]")
    a = df.select(*keep, _once(F.array_remove(F.split(t, SPACE + "+"), "")).alias("__w"), _once(F.filter(F.split(t, "\n"), has_word)).alias("__l"))
    shown = lambda letters: (F.length(t) - F.length(F.translate(t, letters, ""))).cast("long")
    b = a.select(
        *keep, "__w", F.size("__w").cast("long").alias("n_words"), F.length(F.array_join("__w", "")).cast("long").alias("word_chars"), shown(SYMBOLS).alias("n_symbols"),
        F.size("__l").cast("long").alias("n_lines"), (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"), F.size(F.array_distinct("__w")).cast("long").alias("n_distinct_words"),
        (F.length(t) - F.length(F.regexp_replace(t, "[A-Z]", ""))).cast("long").alias("n_upper"), shown(".!?").alias("n_stops"),
    )
    counted = [c for c in COUNTS if c != "n_repeat_words"]
    windows = F.slice(F.transform("__w", lambda w, i: F.struct(F.xxhash64(w, F.get("__w", i + 1), F.get("__w", i + 2)).alias("h"), i.alias("i"))), 1, F.greatest(F.size("__w") - 2, F.lit(0)))
    c = b.select(*keep, *counted, "__w", _once(F.sort_array(windows)).alias("__s"))
    words = lambda x: [F.get("__w", x["i"] + k) for k in range(3)]

    def same(x: Column, j: Column) -> Column:
        """The window beside it has the same hash and the same words."""
        y = F.get("__s", j)
        equal = x["h"] == y["h"]
        for v, w in zip(words(x), words(y), strict=True):
            equal = equal & (v == w)
        return F.coalesce(equal, F.lit(False))

    twice = F.transform(F.filter("__s", lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"].cast("long"))
    d = c.select(*keep, *counted, _once(F.sort_array(twice)).alias("__at"))
    covered = F.aggregate(F.transform("__at", lambda x, j: F.least(F.lit(3).cast("long"), F.coalesce(F.get("__at", j + 1) - x, F.lit(3).cast("long")))), F.lit(0).cast("long"), lambda s, x: s + x)
    return d.select(*keep, *counted, covered.alias("n_repeat_words"))


#: What the conditions of a rule compare, as numbers computed from COUNTS.
FEATURES = {
    "words": lambda c: c["n_words"] * 1.0,
    "chars_per_word": lambda c: c["word_chars"] / c["n_words"],
    "symbols_per_word": lambda c: c["n_symbols"] / c["n_words"],
    "words_per_line": lambda c: c["n_words"] / c["n_lines"],
    "dup_line_share": lambda c: c["n_dup_lines"] / c["n_lines"],
    "repeat_share": lambda c: c["n_repeat_words"] / c["n_words"],
    "distinct_share": lambda c: c["n_distinct_words"] / c["n_words"],
    "upper_share": lambda c: c["n_upper"] / c["word_chars"],
    "stops_per_word": lambda c: c["n_stops"] / c["n_words"],
}


def features() -> dict[str, Column]:
    """The features of a table with statistics; 0 where a denominator is 0."""
    safe = {c: F.when(F.col(c) > 0, F.col(c)) for c in COUNTS}
    return {name: F.coalesce(f({c: safe[c] if c in ("n_words", "n_lines", "word_chars") else F.col(c) for c in COUNTS}), F.lit(0.0)) for name, f in FEATURES.items()}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self) -> Column:
        f = features()[self.feature]
        return f > self.threshold if self.above else f <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _covered(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    return np.logical_and.reduce([c.holds(x) for c in rule]) if rule else np.ones(len(next(iter(x.values()))), bool)


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, cuts: int, longest: int) -> Rule:
    """Adds the condition of largest gain until no good document is covered."""
    rule: list[Condition] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < longest and (inside & ~bad).any():
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        best, chosen = 1e-9, None
        for name, values in x.items():
            v, b = values[inside], bad[inside]
            order = np.argsort(v, kind="stable")
            v, b = v[order], b[order]
            at = np.unique(np.quantile(np.arange(len(v) - 1), np.linspace(0, 1, cuts)).astype(int)) if len(v) > 1 else []
            ends = np.cumsum(b)
            for i in at:
                if v[i] == v[i + 1]:
                    i = int(np.searchsorted(v, v[i], "right")) - 1
                    if i + 1 >= len(v):
                        continue
                threshold = float((v[i] + v[i + 1]) / 2)
                if not v[i] <= threshold < v[i + 1]:
                    threshold = float(v[i])
                for above, p, n in ((False, ends[i], i + 1 - ends[i]), (True, p0 - ends[i], len(v) - i - 1 - (p0 - ends[i]))):
                    if p:
                        gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                        if gain > best:
                            best, chosen = gain, Condition(name, above, threshold)
        if chosen is None:
            break
        rule.append(chosen)
        inside &= chosen.holds(x)
    return tuple(rule)


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The beginning of the rule with the best balance of bad and good on rows it wasn't grown on; the shortest of equals."""

    def worth(r: Rule) -> float:
        inside = _covered(r, x)
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)), default=())


def learn(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.97, rules: int = 12, longest: int = 4, cuts: int = 64, least: int = 5, seed: int = 3) -> list[Rule]:
    """An ordered list of rules that reject; empty if there are no bad documents to learn from."""
    rng = np.random.default_rng(seed)
    left = np.ones(len(bad), bool)
    out: list[Rule] = []
    while len(out) < rules and (left & bad).sum() >= 2 * least:
        rows = np.flatnonzero(left)
        grown = rng.random(len(rows)) < 2 / 3
        part = lambda m: ({k: v[rows[m]] for k, v in x.items()}, bad[rows[m]])
        rule = _prune(_grow(*part(grown), cuts, longest), *part(~grown))
        if not rule:
            break
        inside = _covered(rule, x) & left
        held = inside[rows[~grown]]
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        hp, hn = (held & bad[rows[~grown]]).sum(), (held & ~bad[rows[~grown]]).sum()
        if p < least or p < precision * (p + n) or hp < precision * (hp + hn):
            break
        out.append(rule)
        left &= ~inside
    return out


def verdict(rules: list[Rule]) -> Column:
    """True where no rule rejects: the first rule that holds decides."""
    expression = F
    for rule in rules:
        holds = rule[0].column()
        for c in rule[1:]:
            holds = holds & c.column()
        expression = expression.when(holds, F.lit(False))
    return expression.otherwise(F.lit(True)) if rules else F.lit(True)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = 10_000, **options) -> list[Rule]:
    """Learns from at most ``sample`` labelled documents, those whose keys hash lowest; label 0 is bad, null labels and keys and what base_failed() rejects are left out."""
    few = labels.select(F.col(key).alias("__key"), F.col(label).cast("int").alias("__label")).dropna().orderBy(F.xxhash64("__key"), "__key", "__label").limit(sample)
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).join(F.broadcast(few), "__key")
    found = statistics(rows, "__text").filter(~base_failed()).select((F.col("__label") == 0).alias("bad"), *(c.alias(n) for n, c in features().items())).orderBy(*FEATURES, "bad").collect()
    x = {n: np.array([r[n] for r in found], float) for n in FEATURES}
    return learn(x, np.array([r["bad"] for r in found], bool), **options)


def base_failed() -> Column:
    """Too few words, or over half of them in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with the columns of COUNTS, base_failed and kept."""
    rules = fit(docs, labels, key, text, **options)
    return statistics(docs, text).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))
