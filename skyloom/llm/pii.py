"""Personal data spans, in DataFrame operations only: generators, boosted trees, calibrated thresholds.

Each kind has a base grammar whose valid matches are always reported. Wider generators propose further candidates (spelled-out
addresses, numbers with other separators, phone numbers without a plus), which may overlap each other and base
matches. Boosted trees score candidates from their format and the text beside them. They learn from the corpus
itself, from all generators' candidates: those that are valid (checksum, range, length) are positives, wider ones if a word
beside them announces their kind as well; those that are not valid are negatives, and what validity is computed from is no
feature. All features are small whole numbers, so Spark reduces the candidates of all documents to counts per feature vector, a
table bounded by the features' ranges, and the trees are fitted on that. A kind's threshold is the lowest score at which, on
documents left out of fitting, the wanted precision still holds; the trees' own probability counts as ``PRIOR`` further cases, so
there is a threshold on tables of any size. The trees then are one SQL expression.

Arrays are worked on in blocks, so a text takes time in proportion to its length however many matches it has.
"""

from __future__ import annotations

import math
from collections import defaultdict
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import id_and_text

# The kinds in their order, and the base grammar. Possessive quantifiers match the same text as
# the greedy ones of the definition and need no stack; a look-behind skips starts that cannot be leftmost.
KINDS = ["email", "ip", "card", "phone"]
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
# Words that stand beside personal data, by kind.
CUES = {
    "email": "mail|contact|write|send|reply|address", "ip": r"\bip\b|host|server|addr|login|ping",
    "card": "card|visa|credit|debit|account|pay", "phone": "phone|tel|call|mobile|fax|cell|contact",
}
WIDER = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\]|\{at\})\x20?[A-Za-z0-9-]++"
             r"(?:\x20?(?:\(dot\)|\[dot\]|\{dot\}|\.)\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}([._/])[0-9]{4}\1[0-9]{4}\1[0-9]++",
    "phone": r"(?<![0-9+(.])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
}
#: Characters of context before a match, wanted precision, cases that the trees' own probability counts as, boosting rounds and step.
CONTEXT, PRECISION, PRIOR, ROUNDS, STEP = 24, 0.95, 20, 40, 0.3
FEATURES = ["kind", "wide", "digits", "groups", "separators", "cue", "before", "after"]
#: Elements that are walked one by one; longer arrays are walked in blocks of so many.
BLOCK = 256


def _blocks(values: Column) -> Column:
    """``values``, a plain column (it is read once for each block), in arrays of at most ``BLOCK``."""
    last = F.greatest(F.size(values) - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), F.floor(last / BLOCK).cast("int")), lambda i: F.slice(values, i * BLOCK + 1, BLOCK))


def _walked(values: Column, begin: Column, combine) -> Column:
    """For each of ``values`` what ``combine`` makes of ``begin`` and all values before it. For short arrays."""
    state = F.struct(begin.alias("now"), F.array().cast("array<int>").alias("seen"))
    return F.aggregate(values, state, lambda s, v: F.struct(
        combine(s["now"], v).alias("now"), F.concat(s["seen"], F.array(s["now"])).alias("seen")))["seen"]


def _add(a: Column, b: Column) -> Column:
    return a + b


_SPANS = "array<struct<start:int,end:int,match:string,left:string,right:string>>"


def with_spans(texts: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """``texts`` (with ``text``) and, for each name in ``patterns``, the pattern's leftmost non-overlapping matches.

    They are ``array<struct<start, end, match, left, right>>`` in code points. The text between matches gives where each
    begins, and the ``CONTEXT`` characters before and the one behind it: context ends at the next match of the pattern. Texts
    without a match cost one scan. One projection follows another where a value is used more than once.
    """
    def step(df: DataFrame, make) -> DataFrame:
        return df.select(*[c for c in df.columns if c not in drop], *[make(name).alias(f"{kind}_{name}") for name in patterns])

    drop: set[str] = set()
    col = lambda kind, name: F.col(f"{kind}_{name}")
    kind = "m"
    df = step(texts, lambda n: F.regexp_extract_all("text", F.lit(patterns[n]), F.lit(0)))
    kind = "g"
    df = step(df, lambda n: F.when(F.size(col("m", n)) > 0, F.split("text", patterns[n], -1)))
    kind, drop = "p", {f"{k}_{n}" for k in "mg" for n in patterns}  # done with once these are made
    df = step(df, lambda n: F.zip_with(
        F.zip_with(F.slice(col("g", n), 1, F.size(col("m", n))), F.slice(col("g", n), 2, F.size(col("m", n))), lambda gap, behind: F.struct(
            F.length(gap).alias("gap"), F.substring(gap, -CONTEXT, CONTEXT).alias("left"), F.substring(behind, 1, 1).alias("right"))),
        col("m", n), lambda around, match: F.struct(around.alias("around"), match.alias("match"), F.length(match).alias("size"))))
    kind, drop = "l", set()
    df = step(df, lambda n: F.transform(col("p", n), lambda x: x["around"]["gap"] + x["size"]))
    kind = "b"
    df = step(df, lambda n: _blocks(col("l", n)))
    kind = "t"
    df = step(df, lambda n: _walked(F.transform(col("b", n), lambda block: F.aggregate(block, F.lit(0), _add)), F.lit(0), _add))
    kind, drop = "s", {f"{k}_{n}" for k in "plbt" for n in patterns}
    df = step(df, lambda n: F.coalesce(F.zip_with(
        col("p", n), F.flatten(F.zip_with(col("b", n), col("t", n), lambda block, at: _walked(block, at, _add))), lambda x, at: F.struct(
            (at + x["around"]["gap"]).alias("start"), (at + x["around"]["gap"] + x["size"]).alias("end"), x["match"].alias("match"),
            x["around"]["left"].alias("left"), x["around"]["right"].alias("right"))), F.array().cast(_SPANS)))
    return df.withColumnsRenamed({f"s_{n}": n for n in patterns})


def _luhn(digits: Column) -> Column:
    """Whether 14 to 19 digits pass the Luhn check; longer and shorter strings are not looked at."""
    reverse = F.reverse(digits)
    total = F.lit(0)
    for i in range(19):
        digit = F.greatest(F.ascii(F.substring(reverse, i + 1, 1)) - 48, F.lit(0))  # nothing there counts as 0
        total = total + (digit if i % 2 == 0 else F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit))
    return total % 10 == 0


def valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"\A{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}\z")
    if kind == "card":
        return F.length(digits).between(14, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def valid_wide(kind: str, match: Column) -> Column:
    """Validity of wider candidates: their form is enough, but for cards."""
    return valid(kind, match) if kind == "card" else F.lit(True)


def _features(kind: str, span: Column, wide: bool) -> Column:
    """A candidate's format and surroundings, in small whole numbers. Nothing here tells validity."""
    match = span["match"]
    others = F.regexp_replace(match, "[A-Za-z0-9]++", "")

    def side(character: Column) -> Column:
        return F.when(character == "", 0).when(character.rlike(r"[\s]"), 1).when(
            character.rlike(r"[\p{L}\p{N}]"), 2).otherwise(3)

    return F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), F.lit(int(wide)).alias("wide"),
        F.least(F.floor(F.length(F.regexp_replace(match, "[^0-9]", "")) / 4), F.lit(5)).cast("int").alias("digits"),
        F.least(F.size(F.split(match, "[^A-Za-z0-9]+")), F.lit(6)).alias("groups"),
        F.when(others == "", 0).when(others.rlike(r"\A(.)\1*+\z"), 1).otherwise(2).alias("separators"),
        _cue(kind, span).cast("int").alias("cue"),
        side(F.substring(span["left"], -1, 1)).alias("before"), side(span["right"]).alias("after"))


def _cue(kind: str, span: Column) -> Column:
    return F.lower(span["left"]).rlike(CUES[kind])


class Node(NamedTuple):
    """A tree of depth two: a split on ``feature <= cut``, and on each side another; leaves hold numbers."""

    feature: int
    cut: int
    low: object
    high: object


def _best(cases: list, gradients: list, weights: list, rows: list[int], depth: int):
    """The regression tree of ``depth`` on ``rows``; leaves are Newton steps with one added to the curvature."""
    total_g, total_w = sum(gradients[i] for i in rows), sum(weights[i] for i in rows)
    leaf = total_g / (total_w + 1)
    if not depth:
        return leaf
    best = (1e-9, None)
    for feature in range(len(FEATURES)):
        by_value = defaultdict(lambda: [0.0, 0.0])
        for i in rows:
            cell = by_value[cases[i][feature]]
            cell[0] += gradients[i]
            cell[1] += weights[i]
        g = w = 0.0
        for value in sorted(by_value)[:-1]:
            g, w = g + by_value[value][0], w + by_value[value][1]
            gain = g * g / (w + 1) + (total_g - g) ** 2 / (total_w - w + 1) - total_g ** 2 / (total_w + 1)
            if gain > best[0]:
                best = (gain, (feature, value))
    if best[1] is None:
        return leaf
    feature, cut = best[1]
    return Node(feature, cut, _best(cases, gradients, weights, [i for i in rows if cases[i][feature] <= cut], depth - 1),
                _best(cases, gradients, weights, [i for i in rows if cases[i][feature] > cut], depth - 1))


def _value(tree, case) -> float:
    while isinstance(tree, Node):
        tree = tree.low if case[tree.feature] <= tree.cut else tree.high
    return tree


def boost(counts: list[tuple[tuple, int, int]], rounds: int = ROUNDS, step: float = STEP) -> list:
    """Trees for (features, positives, negatives); each fits the slope of the log loss that the ones before leave."""
    trees: list = []
    cases = [c for c, _, _ in counts]
    scores = [0.0] * len(cases)
    for _ in range(rounds if cases else 0):
        chance = [1 / (1 + math.exp(-s)) for s in scores]
        gradients = [p * (1 - q) - n * q for q, (_, p, n) in zip(chance, counts)]
        weights = [(p + n) * q * (1 - q) for q, (_, p, n) in zip(chance, counts)]
        tree = _best(cases, gradients, weights, list(range(len(cases))), 2)
        trees.append(tree)
        scores = [s + step * _value(tree, c) for s, c in zip(scores, cases)]
    return trees


def score(trees: list, case: tuple, step: float = STEP) -> float:
    return step * sum(_value(tree, case) for tree in trees)


def threshold(scored: list[tuple[float, int, int]], precision: float = PRECISION, prior: float = PRIOR) -> float:
    """The lowest score from which on the share of positives, among ``scored`` held-out cases, is ``precision``.

    To these come ``prior`` cases that are positive as often as the trees say at that score. So without any cases their word
    counts, and the more cases there are, the less it does.
    """
    by_score: dict[float, list[int]] = defaultdict(lambda: [0, 0])
    for value, positives, negatives in scored:
        by_score[value][0] += positives
        by_score[value][1] += negatives
    own = math.log(precision / (1 - precision))
    levels = sorted({*by_score, own, max(own, math.nextafter(max(by_score, default=own), math.inf))}, reverse=True)
    good = bad = 0
    found = max(levels[0], own)  # above all cases, where the trees are sure enough
    for value in levels:
        good, bad = good + by_score[value][0], bad + by_score[value][1]
        if (good + prior / (1 + math.exp(-value))) / (good + bad + prior) >= precision - 1e-9:
            found = value
    return found


def _expression(trees: list, features: Column, step: float = STEP) -> Column:
    def walk(tree) -> Column:
        if not isinstance(tree, Node):
            return F.lit(float(tree))
        return F.when(features[FEATURES[tree.feature]] <= tree.cut, walk(tree.low)).otherwise(walk(tree.high))

    # Equal trees occur often once the loss is flat; a sum in pairs keeps the expression shallow.
    parts = [walk(t) for t in trees] or [F.lit(0.0)]
    while len(parts) > 1:
        parts = [parts[i] + parts[i + 1] if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] * step


def _is_valid(kind: str):
    return lambda span: valid(kind, span["match"])


def _base_case(kind: str):
    return lambda span: F.struct(_features(kind, span, False).alias("features"), valid(kind, span["match"]).alias("good"))


def _is_case(kind: str):
    return lambda span: _cue(kind, span) | ~valid_wide(kind, span["match"])


def _wide_case(kind: str):
    return lambda span: F.struct(_features(kind, span, True).alias("features"), valid_wide(kind, span["match"]).alias("good"))


def _beside_base(kind: str):
    return lambda span: valid_wide(kind, span["match"]) & ~F.exists(
        "base", lambda b: (b["start"] < span["end"]) & (span["start"] < b["end"]))


def _with_features(kind: str):
    return lambda span: F.struct(span["start"].alias("start"), span["end"].alias("end"), _features(kind, span, True).alias("features"))


def _reaches(trees: list, level: float):
    return lambda candidate: _expression(trees, candidate["features"]) >= level


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[list, dict[str, float]]:
    """Trees and each kind's threshold, from all candidates of ``docs``.

    A wider candidate that is valid but that nothing announces is neither positive nor negative and is not learnt from.
    """
    # The fold is made here, before cases become rows, each of which would else read the whole text for it.
    texts = with_spans(id_and_text(docs, id_col, text_col).select("text", (F.crc32("text") % 5).alias("fold")), {
        **{f"raw_{k}": BASE[k] for k in KINDS}, **{f"wide_{k}": WIDER[k] for k in KINDS}})
    wide = [F.transform(F.filter(f"wide_{k}", _is_case(k)), _wide_case(k)) for k in KINDS]
    cases = F.concat(*[F.transform(F.col(f"raw_{k}"), _base_case(k)) for k in KINDS], *wide)
    counted = texts.select("fold", F.explode(cases).alias("case")).groupBy(
        "fold", "case.features").agg(F.sum(F.col("case.good").cast("long")).alias("good"), F.count(F.lit(1)).alias("n"))
    # At most 5 folds times the product of the features' ranges.
    counts = [(r["fold"], tuple(r["features"]), r["good"], r["n"] - r["good"]) for r in counted.collect()]
    counts.sort()
    trees = boost([(c, p, n) for fold, c, p, n in counts if fold])
    levels = {k: threshold([(score(trees, c), p, n) for fold, c, p, n in counts if not fold and c[0] == i])
              for i, k in enumerate(KINDS)}
    return trees, levels


def _named(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end")))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def find_pii(docs: DataFrame, model: tuple[list, dict[str, float]], id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, found`` of every row.

    Counts and the digest are of base spans; ``spans`` has all as ``kind:start:end`` by start, then kind, in code points
    with the end excluded, and ``found`` the same as an array. A wider candidate is added when its score reaches its
    kind's threshold and it overlaps no base span. Null and empty texts have no spans; repeated rows and null ids stay; an
    empty table gives no rows; extra columns are ignored.
    """
    found = _found(id_and_text(docs, id_col, text_col), model)
    return found.select(
        F.col("id").alias("doc_id"), *[f"n_{k}" for k in KINDS], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"), "found")


def _found(texts: DataFrame, model: tuple[list, dict[str, float]]) -> DataFrame:
    """``texts`` (with ``text``) and ``n_<kind>``, ``base`` and ``found`` spans."""
    trees, levels = model
    kept = texts.columns
    kinds = [k for k in KINDS if levels[k] < math.inf]  # a caller may rule a kind out
    texts = with_spans(texts, {**{f"raw_{k}": BASE[k] for k in KINDS}, **{f"wide_{k}": WIDER[k] for k in kinds}})
    wide = [f"wide_{k}" for k in kinds]
    texts = texts.select(*kept, *wide, *[F.filter(f"raw_{k}", _is_valid(k)).alias(f"base_{k}") for k in KINDS])
    texts = texts.select(*kept, *wide, F.concat(*[_named(F.col(f"base_{k}"), k) for k in KINDS]).alias("base"),
                         *[F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS])
    counts = [f"n_{k}" for k in KINDS]
    texts = texts.select(*kept, *counts, "base", *[
        F.transform(F.filter(f"wide_{k}", _beside_base(k)), _with_features(k)).alias(f"wide_{k}") for k in kinds])
    more = [_named(F.filter(f"wide_{k}", _reaches(trees, levels[k])), k) for k in kinds]
    return texts.select(*kept, *counts, "base", F.array_sort(F.concat("base", *more)).alias("found"))


def redact(rows: DataFrame) -> DataFrame:
    """``rows`` (with ``text`` and sorted ``found`` spans) with each span of the text replaced by its kind in brackets.

    Overlapping spans become one, named by the first. Spans are taken in blocks, each with its own stretch of the text.
    """
    kept = [c for c in rows.columns if c not in ("text", "found")]
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    rows = rows.select(*kept, "text", F.when(F.size("found") > 0, _blocks(F.col("found"))).alias("blocks"))
    rows = rows.select("*", F.transform("blocks", lambda block: F.array_max(F.transform(block, lambda s: s["end"]))).alias("lasts"))
    rows = rows.select("*", _walked(F.col("lasts"), F.lit(0), F.greatest).alias("begins"))
    rows = rows.select(*kept, "text", F.array_max("lasts").alias("last"), F.zip_with(
        F.zip_with("blocks", "begins", lambda block, at: F.struct(block.alias("block"), at.alias("at"))), "lasts", lambda b, last: F.struct(
            b["block"].alias("block"), b["at"].alias("at"), F.substring(F.col("text"), b["at"] + 1, last - b["at"]).alias("own"))).alias("parts"))

    def replaced(part: Column) -> Column:
        state = F.struct(part["at"].alias("at"), F.lit("").alias("done"))
        return F.aggregate(part["block"], state, lambda s, span: F.struct(
            F.greatest(span["end"], s["at"]).alias("at"),
            F.concat(s["done"], F.when(span["start"] >= s["at"], F.concat(
                F.substring(part["own"], s["at"] - part["at"] + 1, span["start"] - s["at"]), F.element_at(names, span["kind"] + 1)
            )).otherwise(F.lit(""))).alias("done")))["done"]

    return rows.select(*kept, F.when(F.col("last").isNull(), F.col("text")).otherwise(F.concat(
        F.array_join(F.transform("parts", replaced), ""), F.substring("text", F.col("last") + 1, F.length("text")))).alias("text"))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from the table's own base candidates, then find spans in it; see ``find_pii``."""
    return find_pii(docs, learn(docs, id_col, text_col), id_col, text_col)


def redact_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     length_col: str | None = None) -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced by its kind, and all other columns.

    ``length_col``, if given and there, gets the new text's number of characters. Null texts and their lengths stay as they are.
    """
    rows = docs.select(F.coalesce(docs[text_col], F.lit("")).alias("text"),
                       F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    done = redact(_found(rows, learn(docs, id_col, text_col)).select("row", "text", "found"))
    new = {text_col: F.when(F.col("row")[text_col].isNotNull(), F.col("text"))}
    if length_col in docs.columns:
        new[length_col] = F.when(F.col("row")[text_col].isNotNull(), F.length("text").cast(
            docs.schema[length_col].dataType)).otherwise(F.col("row")[length_col])
    return done.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
