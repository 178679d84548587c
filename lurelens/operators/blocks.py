"""Screenshot text blocks: merging two recognisers, filtering, reading order, statistics and quality.

Blocks are rows (image_id, block_idx, bbox, text, confidence, script); bbox holds four corners [x, y].
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import fixed
from ..functions import labels, text


def _left() -> Column:
    return F.col("bbox")[0][0]


def _top() -> Column:
    return F.col("bbox")[0][1]


def explode_recogniser(outputs: DataFrame, script: str) -> DataFrame:
    """Blocks of recogniser rows (image_id, polys, texts, scores); a text without a box is dropped, a missing score is 0."""
    zipped = F.posexplode(F.arrays_zip("polys", "texts", "scores")).alias("block_idx", "b")
    rows = outputs.select("image_id", zipped).filter(F.col("b.polys").isNotNull() & F.col("b.texts").isNotNull())
    return rows.select("image_id", "block_idx", F.col("b.polys").alias("bbox"), F.col("b.texts").alias("text"), F.coalesce("b.scores", F.lit(0.0)).cast("double").alias("confidence"), F.lit(script).alias("script"))


def explode_pairs(outputs: DataFrame, script: str) -> DataFrame:
    """Blocks of rows (image_id, items) where items is a list of structs (bbox, text, confidence); malformed items are dropped."""
    rows = outputs.select("image_id", F.posexplode("items").alias("block_idx", "b"))
    good = rows.filter((F.size("b.bbox") == 4) & F.col("b.text").isNotNull())
    return good.select("image_id", "block_idx", "b.bbox", "b.text", F.coalesce("b.confidence", F.lit(0.0)).cast("double").alias("confidence"), F.lit(script).alias("script"))


def _size_class(length: Column) -> Column:
    return F.floor(F.log2(length) / 2)


def _cell(centre: Column, size_class: Column) -> Column:
    """The cell of a place, in a grid whose cells are wider than any box of the class."""
    return F.floor(centre / F.pow(F.lit(4.0), size_class + 1))


def _sides(box: str) -> list[tuple[Column, Column]]:
    """Length and centre of a box along both axes."""
    return [((F.col(box)[2][k] - F.col(box)[0][k]).cast("double"), (F.col(box)[2][k] + F.col(box)[0][k]) / 2.0) for k in (0, 1)]


def _reach(length: Column, centre: Column) -> Column:
    """Classes and cells in which a partner lies that overlaps by more than half.

    The partner is more than half and less than twice as long, and its centre at
    most half the longer of both away.
    """

    def cells(size_class: Column) -> Column:
        far = F.greatest(length, F.least(2 * length, F.pow(F.lit(4.0), size_class + 1))) / 2
        return F.transform(F.sequence(_cell(centre - far, size_class), _cell(centre + far, size_class)), lambda c: F.struct(size_class.alias("s"), c.alias("c")))

    return F.flatten(F.transform(F.sequence(_size_class(length / 2), _size_class(length * 2)), cells))


def best_partner(hindi: DataFrame, english: DataFrame) -> DataFrame:
    """For each Hindi block the English block of its image that overlaps most, the first of equals, if by more than half.

    Only blocks of like size in neighbouring cells of a grid are compared, so the
    work follows the number of blocks; boxes without an area overlap nothing.
    """
    h = hindi.select("image_id", F.col("block_idx").alias("hi"), F.col("bbox").alias("hi_box"))
    e = english.select("image_id", F.col("block_idx").alias("en"), F.col("bbox").alias("en_box"))
    placed = []
    for rows, box in ((h, "hi_box"), (e, "en_box")):
        (w, x), (t, y) = _sides(box)
        placed.append(rows.filter((w > 0) & (t > 0)).withColumns({"_w": w, "_x": x, "_h": t, "_y": y}))
    own = {"_sx": _size_class(F.col("_w")), "_sy": _size_class(F.col("_h"))}
    h = placed[0].withColumns(own).withColumns({"_cx": _cell(F.col("_x"), F.col("_sx")), "_cy": _cell(F.col("_y"), F.col("_sy"))})
    e = placed[1].withColumn("_at_x", F.explode(_reach(F.col("_w"), F.col("_x")))).withColumn("_at_y", F.explode(_reach(F.col("_h"), F.col("_y"))))
    e = e.select("image_id", "en", "en_box", F.col("_at_x.s").alias("_sx"), F.col("_at_x.c").alias("_cx"), F.col("_at_y.s").alias("_sy"), F.col("_at_y.c").alias("_cy"))
    pairs = h.join(e, ["image_id", "_sx", "_cx", "_sy", "_cy"]).withColumn("overlap", labels.box_overlap(F.col("hi_box"), F.col("en_box")))
    best = pairs.filter(F.col("overlap") > fixed.MIN_OVERLAP).groupBy("image_id", "hi").agg(F.max_by(F.struct("en", "overlap"), F.struct("overlap", -F.col("en"))).alias("b"))
    return best.select("image_id", "hi", "b.en", "b.overlap")


def merge_scripts(hindi: DataFrame, english: DataFrame) -> DataFrame:
    """One block for each region: the Hindi one if it holds Devanagari, else the English one.

    English blocks that no Hindi block claims stay; unclaimed Hindi blocks stay if they hold Devanagari.
    """
    pairs = best_partner(hindi, english)
    devanagari = text.has_devanagari(F.col("text"))
    claimed = hindi.join(pairs.select("image_id", F.col("hi").alias("block_idx"), "en"), ["image_id", "block_idx"])
    as_hindi = claimed.filter(devanagari).drop("en")
    wanted = claimed.filter(~devanagari).select("image_id", F.col("en").alias("block_idx"))
    as_english = english.join(wanted, ["image_id", "block_idx"])
    free_english = english.join(pairs.select("image_id", F.col("en").alias("block_idx")), ["image_id", "block_idx"], "left_anti")
    free_hindi = hindi.join(pairs.select("image_id", F.col("hi").alias("block_idx")), ["image_id", "block_idx"], "left_anti").filter(devanagari)
    return reduce(DataFrame.unionByName, [as_hindi, as_english, free_english, free_hindi])


def min_confidence(blocks: DataFrame, least: float = fixed.MIN_CONFIDENCE) -> DataFrame:
    return blocks.filter(F.col("confidence") >= least)


def drop_artifacts(blocks: DataFrame, images: DataFrame) -> DataFrame:
    """Drops blocks in the top or bottom tenth of the image (image_id, height), status-bar tokens and button texts."""
    inside = (_top() >= F.col("height") * 0.10) & (F.col("bbox")[2][1] <= F.col("height") * 0.90)
    own = text.trimmed(F.col("text"))
    status = reduce(lambda a, b: a | b, (own.rlike(p) for p in fixed.STATUS_BAR))
    return blocks.join(images.select("image_id", "height"), "image_id").filter(inside & ~status & ~F.lower(own).isin(fixed.UI_TEXTS)).drop("height")


def with_shorthand(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("text", text.expand_shorthand(F.col("text")))


def reading_order(blocks: DataFrame) -> DataFrame:
    """A row per image: image_id and clean_text, lines from top to bottom and words from left to right.

    A block starts a line when it lies 15 pixels or more below the block before it.
    """
    window = Window.partitionBy("image_id").orderBy("_y", "_x", "_script", "block_idx")
    placed = blocks.withColumns({"_y": _top(), "_x": _left(), "_script": F.coalesce("script", F.lit(""))}).withColumn("_order", F.row_number().over(window))
    new = F.coalesce((F.col("_y") - F.lag("_y").over(window) >= fixed.LINE_GAP).cast("int"), F.lit(0))
    lined = placed.withColumn("_new", new).withColumn("_line", F.sum("_new").over(window))
    cells = F.array_sort(F.collect_list(F.struct("_x", "_order", text.trimmed(F.col("text")).alias("t"))))
    lines = lined.groupBy("image_id", "_line").agg(F.array_join(F.transform(cells, lambda c: c["t"]), " ").alias("_text"))
    whole = F.array_sort(F.collect_list(F.struct("_line", "_text")))
    return lines.groupBy("image_id").agg(text.trimmed(F.array_join(F.transform(whole, lambda c: c["_text"]), "\n")).alias("clean_text"))


def statistics(blocks: DataFrame) -> DataFrame:
    """Per image: block count, least, mean and largest confidence, characters, and whether any text is Devanagari."""
    return blocks.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("blocks"),
        F.min("confidence").alias("min_confidence"),
        F.avg("confidence").alias("mean_confidence"),
        F.max("confidence").alias("max_confidence"),
        F.sum(F.length("text")).alias("characters"),
        F.max(text.has_devanagari(F.col("text"))).alias("devanagari"),
    )


def read_images(hindi: DataFrame, english: DataFrame, images: DataFrame) -> DataFrame:
    """From both recognisers' blocks to one row per image: clean text, entities, quality and threat density."""
    kept = min_confidence(merge_scripts(hindi, english))
    cleaned = with_shorthand(drop_artifacts(kept, images))
    lines = text.with_entities(reading_order(cleaned), F.col("clean_text"))
    out = lines.join(statistics(cleaned), "image_id")
    some = F.size("entities.urls") + F.size("entities.upi_ids") + F.size("entities.phone_numbers") > 0
    return out.withColumns({
        "quality": labels.ocr_quality(F.col("mean_confidence"), some, F.col("characters")),
        "threat_density": labels.threat_density(F.regexp_replace("clean_text", "\n", " "), F.col("entities")),
    })
