"""The thin queries of the operators in this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import spread
from . import collocations, conversations, decontaminate, jaccard_join, language_id, language_model, license_scan, ordinal, packing, quality_rules, sharding, suffix_dedup, warc
from .scratch import Scratch

TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op2_size_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appends documents as small shards, compacts them, and reads the newest version back."""
    docs = _table(spark, sf_dir, "documents")
    store = sharding.ShardStore(spark, f"{Scratch(spark, 'shards').path}", target_bytes=32 << 20)
    store.append(sharding.arrivals(docs, ("doc_id",), 20, store.target_bytes // 4))
    store.compact_fully()
    found = store.read(docs.schema)
    text = F.coalesce(F.col("text"), F.lit(""))
    return found.select("doc_id", "lang", "source", "n_chars", F.octet_length(text).cast("long").alias("text_bytes"), F.md5(F.encode(text, "UTF-8")).alias("text_md5"))


def op3_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(_table(spark, sf_dir, "documents"))


def op4_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(_table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(_table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damages conversations and repairs them."""
    return conversations.repair(conversations.damage(_table(spark, sf_dir, "conversations")))


#: The table of the CRC-32 checksum as a list, and the checksum of an ASCII string by a column ``crc`` that holds it.
_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))"


def _crc(text: str) -> str:
    places = f"list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"xor(4294967295, list_reduce([CAST(4294967295 AS BIGINT)] || {places}, lambda a, b: xor(a >> 8, crc[1 + (xor(a, b) & 255)])))"


def _edited(way: str, cost: str, letters: str) -> str:
    """A way, its cost in eight digits and its audit, with an edit more; null stays null."""
    return f"(lpad(CAST(CAST(left({way}, 8) AS BIGINT) + {cost} AS VARCHAR), 8, '0') || substr({way}, 9) || '{letters}')"


def _entered(cost: str, letter: str) -> tuple[str, str]:
    """The least ways to a user's and to an assistant's turn from the states i0 to i3."""
    return ", ".join(_edited(f"i{k}", cost, letter) for k in (0, 1, 3)), _edited("i2", cost, letter)


#: States before a row, with the turns that may be inserted there.
_INSERTED = f"""s0 AS i0, s1 AS i1, least(s2, {_edited("s0", "2", "I")}, {_edited("s1", "2", "I")}, {_edited("s3", "2", "I")}) AS i2,
                least(s3, {_edited("s2", "2", "I")}, {_edited("s0", "4", "II")}, {_edited("s1", "4", "II")}) AS i3"""
_KEPT, _REROLED = _entered("cut", "K"), _entered("2 + cut", "R")

QUERIES = {
    f.__name__: f
    for f in (
        op1_warc,
        op2_size_tiered_shards,
        op3_deleted_interpolation,
        op4_ordinal_quality,
        op5_license_scan,
        op6_jaccard_join,
        op7_best_fit_packing,
        op8_suffix_dedup,
        op9_quality_rules,
        op10_decontamination,
        op11_rank_order_language,
        op12_collocations,
        op13_conversation_repair,
    )
}

SQL: dict[str, str] = {
    "op1_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
        m AS (SELECT h, max(page_id) AS chosen FROM d WHERE n >= 1000 GROUP BY h)
        SELECT page_id, url, n AS payload_bytes, d.h AS payload_digest,
               CASE WHEN chosen IS NOT NULL AND chosen <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN chosen <> page_id THEN chosen END AS refers_to
        FROM d JOIN (SELECT page_id, url FROM pages) u USING (page_id) LEFT JOIN m ON d.h = m.h AND d.n >= 1000""",
    "op2_size_tiered_shards": """
        SELECT doc_id, lang, source, n_chars, octet_length(encode(coalesce(text, ''))) AS text_bytes, md5(coalesce(text, '')) AS text_md5
        FROM documents""",
    "op6_jaccard_join": """
        WITH RECURSIVE t AS (
            SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS w
            FROM documents),
        s AS (
            SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END) AS g
            FROM t),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
        r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.b) AS component_id
        FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.a = d.doc_id GROUP BY ALL""",
    "op11_rank_order_language": f"""
        WITH t AS (SELECT {_CRC_TABLE} AS crc),
        d AS (SELECT doc_id, lang, coalesce(text, '') AS text, {_crc("CAST(doc_id AS VARCHAR)")} % 4 = 2 AS held_out FROM documents, t),
        w AS (SELECT doc_id, unnest([x FOR x IN string_split(regexp_replace(lower(text), '[^\\p{{L}}\\p{{M}}]+', ' ', 'g'), ' ') IF x <> '']) AS w FROM d),
        p AS (SELECT doc_id, ' ' || w || ' ' AS p, count(*) AS n FROM w GROUP BY ALL),
        s AS (SELECT doc_id, n, unnest(flatten([[substr(p, i, k) FOR i IN range(1, length(p) - k + 2)] FOR k IN range(1, 4)])) AS g FROM p),
        g AS (SELECT doc_id, g, sum(n) AS n FROM s WHERE g <> ' ' GROUP BY ALL),
        l AS (SELECT lang, g, sum(n) AS n FROM g JOIN d USING (doc_id) WHERE NOT held_out AND lang IS NOT NULL GROUP BY ALL),
        f AS (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY n DESC, g) AS place FROM l QUALIFY place <= 400),
        r AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, g) AS place FROM g QUALIFY place <= 400),
        m AS (SELECT doc_id, 400 * count(*) AS most FROM r GROUP BY doc_id),
        h AS (SELECT doc_id, lang, sum(400 - abs(f.place - r.place)) AS saved FROM r JOIN f USING (g) GROUP BY ALL),
        c AS (
            SELECT doc_id, lang, most, CAST(most - coalesce(saved, 0) AS BIGINT) AS distance
            FROM m JOIN (SELECT DISTINCT lang FROM f) x ON true JOIN (SELECT doc_id FROM d WHERE regexp_matches(text, '\\p{{L}}')) y USING (doc_id) LEFT JOIN h USING (doc_id, lang)),
        b AS (SELECT doc_id, lang, most, distance FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY distance, lang) = 1)
        SELECT d.doc_id, held_out, coalesce(b.lang, 'und') AS lang_pred, coalesce(1 - distance / most, 0.0) AS score, distance
        FROM d LEFT JOIN b USING (doc_id)""",
    "op12_collocations": """
        WITH p AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
            FROM documents),
        w AS (SELECT lang, [x FOR x IN string_split_regex(piece, '[\\x20\\x09]+') IF x <> ''] AS w FROM p),
        n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
        g AS (SELECT lang, unnest(flatten([[array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)] FOR k IN range(1, 6)])) AS g FROM w),
        f AS (SELECT lang, g, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
        c AS (SELECT lang, g, a, string_split(g, ' ') AS w FROM f WHERE contains(g, ' ')),
        k AS (SELECT *, unnest(range(1, len(w))) AS k FROM c),
        s AS (
            SELECT k.lang, k.g, k.a, k.k, x.a AS l, y.a AS r, n.n, (CAST(1000 AS HUGEINT) * k.a * n.n) // (CAST(x.a AS HUGEINT) * y.a) AS score
            FROM k JOIN n ON n.lang = k.lang
            JOIN f x ON x.lang = k.lang AND x.g = array_to_string(k.w[1:k.k], ' ')
            JOIN f y ON y.lang = k.lang AND y.g = array_to_string(k.w[k.k + 1:], ' ')),
        b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
        i AS (SELECT DISTINCT c.lang, c.g FROM c JOIN c z ON z.lang = c.lang AND len(z.w) > len(c.w) AND 100 * z.a >= 100 * c.a AND contains(' ' || z.g || ' ', ' ' || c.g || ' '))
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank, g AS phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
        FROM b ANTI JOIN i USING (lang, g) QUALIFY rank <= 2000""",
    "op13_conversation_repair": f"""
        WITH RECURSIVE
        t AS (SELECT {_CRC_TABLE} AS crc),
        c AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                {_crc("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS code
            FROM conversations, t),
        d AS (
            SELECT conv_id, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                unnest(range(CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
            FROM c),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text), copy) AS pos FROM d),
        f AS (
            SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS former,
                NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank,
                row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
                NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS open
            FROM o),
        w AS (SELECT *, blank OR again AS gone, CASE WHEN NOT blank AND NOT again AND open THEN 1 ELSE 0 END AS cut FROM f),
        i AS (SELECT DISTINCT conv_id FROM conversations),
        r AS (
            SELECT conv_id, CAST(0 AS BIGINT) AS pos, '00000000' AS s0, CAST(NULL AS VARCHAR) AS s1, CAST(NULL AS VARCHAR) AS s2, CAST(NULL AS VARCHAR) AS s3 FROM i
            UNION ALL
            SELECT conv_id, pos, {_edited("i0", "3", "D")},
                least({_edited("i1", "3", "D")}, CASE WHEN NOT gone AND initial = 's' THEN {_edited("i0", "cut", "K")} END),
                least({_edited("i2", "3", "D")}, CASE WHEN NOT gone AND initial = 'u' THEN least({_KEPT[0]}) END, CASE WHEN NOT gone THEN least({_REROLED[0]}) END),
                least({_edited("i3", "3", "D")}, CASE WHEN NOT gone AND initial = 'a' THEN {_KEPT[1]} END, CASE WHEN NOT gone THEN {_REROLED[1]} END)
            FROM (SELECT w.conv_id, w.pos, w.initial, w.gone, w.cut, {_INSERTED} FROM r JOIN w ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND w.pos = r.pos + 1) x),
        l AS (SELECT conv_id, max(pos) AS last FROM r GROUP BY conv_id),
        e AS (
            SELECT conv_id, least(i0, i3) AS way
            FROM (SELECT r.conv_id, {_INSERTED} FROM r JOIN l ON l.conv_id IS NOT DISTINCT FROM r.conv_id AND l.last = r.pos) x),
        a AS (SELECT conv_id, CAST(left(way, 8) AS BIGINT) AS cost, substr(way, 9) AS audit, length(replace(substr(way, 9), 'D', '')) % 2 AS opening FROM e),
        j AS (SELECT conv_id, audit, opening, unnest(range(1, length(audit) + 1)) AS k FROM a),
        g AS (SELECT conv_id, opening, k, audit[k] AS edit, length(replace(left(audit, k), 'I', '')) AS pos, length(replace(left(audit, k), 'D', '')) AS place FROM j),
        h AS (
            SELECT g.conv_id, string_agg(
                CASE edit WHEN 'K' THEN w.role ELSE CASE (place + opening) % 2 WHEN 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE edit WHEN 'I' THEN '' ELSE w.text END,
                chr(10) ORDER BY k) AS text
            FROM g LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM g.conv_id AND w.pos = g.pos WHERE edit <> 'D' GROUP BY g.conv_id),
        n AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, sum(cut) AS truncated,
                count(*) FILTER (former || initial NOT IN ('su', 'ua', 'au')) AS illegal
            FROM w GROUP BY conv_id)
        SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, coalesce(illegal, 0) AS illegal,
            cost, audit, sha256(coalesce(h.text, '')) AS repaired_sha256
        FROM a LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM a.conv_id""",
}
