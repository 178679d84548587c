"""Column builders for lexicon classifiers, weak labels and score arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from .text import any_of, count_of, once


def first_maximum(values: Column) -> Column:
    """Position, from 1, of the first largest value."""
    return F.array_position(values, F.array_max(values)).cast("int")


def dual_keys(scores: dict[str, Column], prefix: str = "social_") -> Column:
    """The map of scores under prefixed and bare names."""
    return F.create_map(*(x for before in (prefix, "") for k, v in scores.items() for x in (F.lit(before + k), v)))


def _social(counts: dict[str, Column]) -> dict[str, Column]:
    """Probability of each social-engineering facet by the number of its words found."""
    return {k: F.when(n > 0, F.least(F.lit(0.95), n * F.lit(0.45))).otherwise(F.lit(0.05)) for k, n in counts.items()}


def _intent(counts: dict[str, Column], most: Column, total: Column) -> Column:
    """Struct of detected_intent, confidence, is_scam and the map of probabilities; the first of equals wins."""
    found = most > 0
    share = lambda n: F.bround(n / total, 3)
    rest = F.when(found, share(F.lit(1))).otherwise(F.lit(0.90))
    name = F.when(~found, fixed.BENIGN)
    for k, n in counts.items():
        name = name.when(n == most, k)
    probabilities = [x for k, n in counts.items() for x in (F.lit(k), F.when(found, share(n)).otherwise(F.lit(0.02)))]
    return F.struct(
        name.alias("detected_intent"),
        F.when(found, share(most)).otherwise(rest).alias("confidence"),
        found.alias("is_scam"),
        F.create_map(*probabilities, F.lit(fixed.BENIGN), rest).alias("probabilities"),
        rest.alias("benign"),
    )


def _text_track(social: dict[str, Column], intent: Column) -> Column:
    triggers = F.array_compact(F.array(*(F.when(p >= 0.5, f) for f, p in social.items())))
    risk = (F.greatest(*social.values(), F.lit(1.0) - intent["benign"]) * 100).cast("int")
    return F.struct(
        risk.alias("risk_score"),
        intent["is_scam"].alias("is_scam"),
        dual_keys(social).alias("social_engineering"),
        triggers.alias("triggers"),
        intent["detected_intent"].alias("detected_intent"),
        F.bround(intent["confidence"], 3).alias("confidence"),
        intent["probabilities"].alias("probabilities"),
    )


def _totals(counts: dict[str, Column]) -> tuple[Column, Column]:
    return F.greatest(*counts.values()), sum(counts.values(), F.lit(1))


def intent_scores(text: Column) -> Column:
    counts = {k: count_of(F.lower(text), words) for k, words in fixed.INTENT_WORDS.items()}
    return _intent(counts, *_totals(counts))


def text_result(text: Column) -> Column:
    """The text track: risk, is_scam, facets, triggers and intent, from the lexicons alone, as one column."""
    social = _social({k: count_of(F.lower(text), words) for k, words in fixed.SOCIAL_WORDS.items()})
    return _text_track(social, intent_scores(text))


def with_text_result(df: DataFrame, source: Column, name: str = "text_track") -> DataFrame:
    """Adds the text track under a name.

    Each step is a projection of its own that later ones read several times, so
    the text is lowered once and each list counted once, in compiled code.
    """
    groups = {"social": fixed.SOCIAL_WORDS, "intent": fixed.INTENT_WORDS}
    column = {(g, k): f"__{name}_{g}_{k}" for g, lists in groups.items() for k in lists}
    low, most, total, intent = (f"__{name}_{x}" for x in ("low", "most", "total", "scores"))
    out = df.withColumn(low, F.lower(source))
    out = out.withColumns({column[g, k]: count_of(F.col(low), words) for g, lists in groups.items() for k, words in lists.items()})
    counts = {g: {k: F.col(column[g, k]) for k in lists} for g, lists in groups.items()}
    out = out.withColumns(dict(zip((most, total), _totals(counts["intent"]), strict=True)))
    out = out.withColumn(intent, _intent(counts["intent"], F.col(most), F.col(total)))
    out = out.withColumns({column["social", k]: v for k, v in _social(counts["social"]).items()})
    out = out.withColumn(name, _text_track(counts["social"], F.col(intent)))
    return out.drop(low, most, total, intent, *column.values())


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax(logits: Column) -> Column:
    shifted = lambda x: F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return once(shifted(logits), lambda e: F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)))


def two_heads(social_logits: Column, intent_logits: Column, facets: list[str], intents: list[str], benign: str, thresholds: dict[str, float] | None = None, threshold: float = 0.5) -> Column:
    """Decision over two heads of logits: per-facet thresholds, first largest intent, risk from 0 to 100."""
    cuts = F.array(*(F.lit(float((thresholds or {}).get(f, threshold))) for f in facets))

    def judge(x: Column) -> Column:
        best = first_maximum(x["p"])
        off = F.element_at(x["p"], intents.index(benign) + 1)
        triggers = F.array_compact(F.zip_with(F.zip_with(F.array(*map(F.lit, facets)), x["s"], lambda f, p: F.struct(f.alias("f"), p.alias("p"))), cuts, lambda y, c: F.when(y["p"] >= c, y["f"])))
        return F.struct(
            (best != intents.index(benign) + 1).alias("is_scam"),
            F.bround(F.greatest(1 - off, F.array_max(x["s"]), F.lit(0.0)) * 100).cast("int").alias("risk_score"),
            F.element_at(F.array(*map(F.lit, intents)), best).alias("predicted_intent"),
            F.bround(F.element_at(x["p"], best), 4).alias("intent_confidence"),
            triggers.alias("triggers"),
        )

    return once(F.struct(F.transform(social_logits, sigmoid).alias("s"), softmax(intent_logits).alias("p")), judge)


def weak_social(text: Column, is_scam: Column, low: Column | None = None) -> Column:
    """Binary facets of a training record; all 0 unless it is a scam; ``low`` is the text in lower case, if it is there already."""
    low = F.lower(text) if low is None else low
    return F.struct(*(F.when(is_scam == 1, any_of(low, w).cast("int")).otherwise(0).alias(f) for f, w in fixed.WEAK_SOCIAL_WORDS.items()))


def weak_intent(text: Column, is_scam: Column, low: Column | None = None) -> Column:
    """The first group of words that occurs names the intent."""
    low = F.lower(text) if low is None else low
    out = F.when(is_scam != 1, fixed.BENIGN)
    for intent, words in fixed.WEAK_INTENT_WORDS.items():
        out = out.when(any_of(low, words), intent)
    return out.otherwise(fixed.OTHER_INTENT)


def truth_label(text: Column, low: Column | None = None) -> Column:
    return any_of(F.lower(text) if low is None else low, fixed.TRUTH_WORDS).cast("int")


def is_threat(text: Column) -> Column:
    return any_of(text, fixed.THREAT_WORDS_HI)


def threat_density(text: Column, entities: Column) -> Column:
    """Two points for each urgency and authority word, three for URLs and payment ids, two for phones and amounts."""
    low = F.lower(text)
    words = 2 * count_of(low, fixed.RANK_URGENCY) + 2 * count_of(low, fixed.RANK_AUTHORITY)
    return words + 3 * F.size(entities["urls"]) + 3 * F.size(entities["upi_ids"]) + 2 * F.size(entities["phone_numbers"]) + 2 * F.size(entities["amounts"])


def ocr_quality(mean_confidence: Column, has_entity: Column, characters: Column) -> Column:
    return 0.4 * mean_confidence + 0.3 * has_entity.cast("double") + 0.3 * F.least(F.lit(1.0), characters / 50.0)


def category(score: Column) -> Column:
    return F.when(score <= 30, "Safe").when(score <= 60, "Suspicious").otherwise("High Risk")


def box_overlap(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes given by four corners, first and third opposite; 0 for empty boxes."""
    width = F.greatest(F.lit(0), F.least(a[2][0], b[2][0]) - F.greatest(a[0][0], b[0][0]))
    height = F.greatest(F.lit(0), F.least(a[2][1], b[2][1]) - F.greatest(a[0][1], b[0][1]))
    area = lambda x: (x[2][0] - x[0][0]) * (x[2][1] - x[0][1])
    whole = area(a) + area(b) - width * height
    return F.when(whole == 0, 0.0).otherwise(width * height / whole)


def over_threshold(scores: Column, cuts: dict[str, float], threshold: float = 0.5) -> Column:
    """Names whose probability reaches their own threshold or the common one."""
    table = F.create_map(*(y for k, v in cuts.items() for y in (F.lit(k), F.lit(float(v))))) if cuts else None
    cut = lambda k: F.coalesce(F.try_element_at(table, k), F.lit(threshold)) if cuts else F.lit(threshold)
    return F.map_keys(F.map_filter(scores, lambda k, v: v >= cut(k)))
