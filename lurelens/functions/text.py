"""Column builders for text: cleaning, URL healing, entities, flags, language, keys and distances."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed


_SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def quick(pattern: str) -> str:
    """The same pattern for the engine of Spark, which tries it at every character.

    Printable ASCII characters are told from white space by one range instead of
    all, and a word border is looked for only where what follows it may begin.
    """
    # Before a letter or a digit a border is where no such character stands before it.
    begun = rf"(?<!{fixed.WORD})"
    for first, edge, rest in ((r"\p{Nd}", begun, r"\p{Nd}"), ("[opvओप]", begun, "(?:otp|"), ("[+0-9]", fixed.EDGE, r"(?:\+91|91|0)?[6-9]")):
        pattern = pattern.replace(fixed.EDGE + rest, f"(?={first}){edge}{rest}")
    return pattern.replace(fixed.SPACE, f"[[^!-~]&&{fixed.SPACE}]").replace(fixed.NOT_SPACE, f"[!-~{fixed.NOT_SPACE}]")


_GAP, _SEEN = quick(fixed.SPACE), quick(fixed.NOT_SPACE)
_ID_HINT = rf"\p{{Nd}}{{4}}{_GAP}\p{{Nd}}{{4}}{_GAP}"


def once(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def filled(sentence: str, **parts: Column) -> Column:
    """A sentence with columns in the places named in braces."""
    pieces = sentence.replace("}", "{").split("{")
    return F.concat(*(parts[x] if x in parts else F.lit(x) for x in pieces))


def words_array(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def any_of(text: Column, words: list[str]) -> Column:
    """Whether any of the words is a substring."""
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def count_of(text: Column, words: list[str]) -> Column:
    """How many entries of the list are substrings; repeated entries count each time."""
    return reduce(lambda a, b: a + b, (text.contains(w).cast("int") for w in words))


def trimmed(text: Column) -> Column:
    """A text without white space at its ends; only those two characters are looked at if neither is."""
    ends = F.concat(F.left(text, F.lit(1)), F.right(text, F.lit(1)))
    return F.when(ends.rlike(fixed.SPACE), F.btrim(text, F.lit(_SPACES))).otherwise(text)


def collapsed(text: Column) -> Column:
    """White space runs become one space, ends are trimmed."""
    return F.trim(F.regexp_replace(text, f"{_GAP}+", " "))


#: For each group of steps substrings, and a pattern, without one of which none of its patterns can match.
_STITCH_HINTS = (
    (["// ", "//\t", "//\n", "www. ", "www.\t", "www.\n"], None),
    (["- ", "-\t", "-\n"], rf"(?::/|[wW]\.){_SEEN}*+[ \t]*+\n"),
    (["- ", "-\t"], None),
    (["/ ", "/\t", " /", "\t/"], None),
)
_HEAL_HINTS = (
    (["/ ", "/\t", "www. ", "www.\t"], r":[a-zA-Z0-9\-]++\.[a-zA-Z]{2}"),
    (["- ", "-\t"], None),
)


def _hinted(text: Column, hints) -> Column:
    """Whether a text has one of the marks that any of these groups needs."""
    marks = list(dict.fromkeys(m for own, _ in hints for m in own))
    patterns = [p for _, p in hints if p]
    found = any_of(text, marks)
    return found | text.rlike("|".join(patterns)) if patterns else found


def _steps(text: Column, steps, hints) -> Column:
    """Groups of steps in turn; a text without the hint of a group skips it, and rounds end with the first that changes nothing."""

    def rounds(t: Column, pairs, left: int) -> Column:
        out = t
        for pattern, replacement in pairs:
            out = F.regexp_replace(out, quick(pattern), replacement)
        return out if left == 1 else once(out, lambda new: F.when(new == t, new).otherwise(rounds(new, pairs, left - 1)))

    for (most, pairs), hint in zip(steps, hints, strict=True):
        # The body is called at once, so it sees this group's values.
        text = once(text, lambda t: F.when(_hinted(t, [hint]), rounds(t, pairs, most)).otherwise(t))  # noqa: B023
    return text


def stitch_urls(text: Column) -> Column:
    """Joins URLs that were wrapped over lines or split by spaces."""
    return _steps(text, fixed.STITCH_STEPS, _STITCH_HINTS)


def heal_urls(text: Column) -> Column:
    """``stitch_urls``, then spaces after colons, protocols, slashes and hyphens of hosts.

    A text that no group of steps can change at first is not changed by any, so most texts skip the chain.
    """
    return F.when(_hinted(text, _STITCH_HINTS + _HEAL_HINTS), _steps(stitch_urls(text), fixed.HEAL_STEPS, _HEAL_HINTS)).otherwise(text)


def repair_url(url: Column) -> Column:
    for wrong, right in fixed.URL_REPAIRS:
        url = F.replace(url, F.lit(wrong), F.lit(right))
    return url


#: Without one of these there is no URL.
_URL_HINT = rf"\.(?iu:{fixed.TLDS})|:/|[wW]\."
#: A host begins where no character of one stands before it, or where a match has just ended: a later start is part of the same match, and if it has no dot behind it, neither has any later one.
_QUICK_URL = fixed.URL.replace(r"|[a-zA-Z0-9\-]+\.", r"|(?:(?<![a-zA-Z0-9\-])|\G)[a-zA-Z0-9\-]++\.")


def urls_in(healed: Column) -> Column:
    """URLs of a healed text, longest first; one that is part of a longer or earlier one is left out."""
    found = F.when(healed.rlike(_URL_HINT), F.regexp_extract_all(healed, F.lit(_QUICK_URL), F.lit(0))).when(healed.isNotNull(), F.array().cast("array<string>"))
    clean = F.filter(F.transform(found, lambda u: F.regexp_replace(repair_url(u), fixed.URL_TAIL, "")), lambda u: u != "")
    # Negative lengths and positions sort longest first and keep the order of equals.
    ordered = F.array_sort(F.transform(clean, lambda u, i: F.struct((-F.length(u)).alias("n"), i.alias("i"), u.alias("u"))))
    none = F.array().cast("array<string>")
    keep = lambda kept, x: F.when(F.exists(kept, lambda k: k.contains(x["u"])), kept).otherwise(F.concat(kept, F.array(x["u"])))
    return F.aggregate(ordered, none, keep)


def extract_urls(text: Column) -> Column:
    return urls_in(heal_urls(text))


def url_netlocs(urls: Column) -> Column:
    """Network locations, sorted and distinct; user, port and www. stay."""
    whole = F.transform(urls, lambda u: F.when(u.startswith("http"), u).otherwise(F.concat(F.lit("http://"), u)))
    return F.array_sort(F.array_distinct(F.filter(F.transform(whole, lambda u: F.regexp_extract(u, r"^[^:/?#]+://([^/?#]*)", 1)), lambda h: h != "")))


def _distinct(text: Column, hint: str, pattern: str, group: int = 0) -> Column:
    """All distinct matches, sorted; texts without the hint, a cheaper pattern that every match holds, are not searched."""
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(quick(pattern)), F.lit(group))))
    return F.when(text.rlike(hint), found).otherwise(F.array().cast("array<string>"))


def upi_ids(text: Column) -> Column:
    return _distinct(text, "@", fixed.UPI_ID)


def phone_numbers(text: Column) -> Column:
    return _distinct(text, r"[6-9]\p{Nd}{9}", fixed.PHONE)


def otp_candidates(text: Column, phones: Column) -> Column:
    """Numbers of four to six digits that are not part of a phone number."""
    return F.filter(_distinct(text, r"\p{Nd}{4}", fixed.CODE), lambda n: ~F.exists(phones, lambda p: p.contains(n)))


def amounts(text: Column) -> Column:
    return _distinct(text, r"\p{Nd}", fixed.AMOUNT, 1)


def bank_names(text: Column, upper: Column | None = None) -> Column:
    """Institutions named as whole words, in the order of the list; ``upper`` is the text in upper case, if it is there already."""
    upper = F.upper(text) if upper is None else upper
    found = F.array_compact(F.array(*(F.when(upper.contains(b) & upper.rlike(fixed.EDGE + b + fixed.EDGE), b) for b in fixed.BANK_NAMES)))
    return F.when(any_of(upper, fixed.BANK_NAMES), found).otherwise(F.array().cast("array<string>"))


def redacted(text: Column) -> Column:
    return F.when(text.rlike(_ID_HINT), F.regexp_replace(text, quick(fixed.NATIONAL_ID), fixed.NATIONAL_ID_MASK.replace("[", "\\[").replace("]", "\\]"))).otherwise(text)


def national_ids(text: Column) -> Column:
    """How many national ids there are; texts without the digits of one are not searched."""
    count = F.regexp_count(text, F.lit(quick(fixed.NATIONAL_ID)))
    return F.when(text.rlike(_ID_HINT), count).when(text.isNotNull(), 0)


def has_devanagari(text: Column) -> Column:
    return text.rlike(fixed.DEVANAGARI)


def marathi(text: Column) -> Column:
    """Whether the text has the letter that Hindi lacks, or a Marathi-only word, all of which are Devanagari."""
    words = F.split(F.regexp_replace(text, r"[^\p{L}\p{N}_\sऀ-ॿ]", " "), f"{_GAP}+")
    return text.contains("ळ") | (has_devanagari(text) & F.arrays_overlap(words, words_array(fixed.MARATHI_WORDS)))


def tokens(text: Column) -> Column:
    """Lower-case tokens without punctuation at their ends."""
    split = F.filter(F.split(F.lower(text), f"{_GAP}+"), lambda w: w != "")
    return F.transform(split, lambda w: F.btrim(w, F.lit(fixed.TOKEN_EDGE)))


def detect_language(text: Column, own: Column | None = None) -> Column:
    """Hindi by script, Hinglish by one strong word or two distinct particles, else English; ``own`` are the text's tokens, if they are there already."""
    own = tokens(text) if own is None else own
    strong = F.arrays_overlap(own, words_array(fixed.STRONG_INDIC_WORDS))
    particles = F.size(F.array_intersect(own, words_array(fixed.INDIC_PARTICLES))) >= 2
    return F.when(has_devanagari(text), "Hindi").when(strong | particles, "Hinglish").otherwise("English")


def indic_kind(text: Column, own: Column | None = None) -> Column:
    """Hindi, Hinglish or English by the inclusion rule that counts tokens."""
    own = tokens(text) if own is None else own
    some = F.arrays_overlap(own, words_array(fixed.HINGLISH_MARKERS))
    strong = F.arrays_overlap(own, words_array(fixed.HINGLISH_STRONG))
    hits = F.size(F.filter(own, lambda t: t.isin(fixed.HINGLISH_MARKERS)))
    many = (hits >= 2) | (hits / F.greatest(F.size(own), F.lit(1)) >= 0.05)
    return F.when(has_devanagari(text), "Hindi").when(some & (strong | many), "Hinglish").otherwise("English")


def purity(text: Column, own: Column | None = None) -> Column:
    """true_indic, ambiguous or none, by the core and the ambiguous words."""
    own = tokens(text) if own is None else own
    return F.when(F.arrays_overlap(own, words_array(fixed.INDIC_CORE_WORDS)), "true_indic").when(F.arrays_overlap(own, words_array(fixed.AMBIGUOUS_WORDS)), "ambiguous").otherwise("none")


def template_key(text: Column) -> Column:
    """Lower-case text with URLs, phones, amounts and numbers masked and punctuation dropped."""
    (url, mark), *rest = fixed.TEMPLATE_STEPS
    # What stands before a dot begins where no such character is before it, as a later start is part of the same match;
    # from there each dot is met once, and texts without any mark of a URL are not searched.
    host, end = url.rsplit(rf"|{fixed.NOT_SPACE}+\.", 1)
    ends = end[: end.index(")") + 1]
    label = rf"[{_SEEN}&&[^.]]*+\."
    linear = rf"{quick(host)}|(?<!{_SEEN}){_SEEN}(?:{label}(?!{ends}))*+{label}{ends}{_SEEN}*"
    out = once(trimmed(F.lower(text)), lambda t: F.when(t.rlike(rf"://|www\.|\.{ends}"), F.regexp_replace(t, linear, mark)).otherwise(t))
    for pattern, replacement in rest:
        out = F.regexp_replace(out, quick(pattern), replacement)
    return F.trim(out)


def content_hash(text: Column, normalised: bool = True) -> Column:
    return F.sha2(F.lower(trimmed(text)) if normalised else text, 256)


def content_flags(text: Column, flags: dict[str, str] | None = None) -> Column:
    """Whether each pattern occurs; of what stands before a dot one character is enough for that, and a payment id has its sign."""
    found = {k: text.rlike(quick(p).replace(r"[a-zA-Z0-9\-]+\.(?:", r"[a-zA-Z0-9\-]\.(?:")) for k, p in (flags or fixed.FLAGS).items()}
    signed = {k for k, p in (flags or fixed.FLAGS).items() if p == fixed.UPI_ID}
    return F.struct(*((text.contains("@") & v if k in signed else v).alias(k) for k, v in found.items()))


def expand_shorthand(text: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in fixed.SHORTHAND.items() for x in pair))
    own = F.filter(F.split(text, f"{_GAP}+"), lambda w: w != "")
    return F.array_join(F.transform(own, lambda w: F.coalesce(F.try_element_at(table, F.lower(w)), w)), " ")


def look_alike_skeleton(text: Column) -> Column:
    for seen, meant in fixed.LOOK_ALIKES:
        text = F.replace(text, F.lit(seen), F.lit(meant))
    return text


def url_key(url: Column) -> Column:
    """URL-safe base64 without padding or line breaks."""
    plain = F.regexp_replace(F.base64(F.encode(url, "UTF-8")), "[\r\n=]", "")
    return F.translate(plain, "+/", "-_")


def brand_slug(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"[ ()]|bank", "")


def character_distance(a: Column, b: Column) -> Column:
    """Edit distance of two texts.

    Distances up to a limit are found in a band of that width along the diagonal,
    so the work follows the length times the distance; only where the limits do
    not do is the whole table filled.  Before that, a text that only lacks characters of
    the other is told in one pass, and is as far from it as it is shorter.
    """
    characters = lambda x: F.regexp_extract_all(x, F.lit("(?s)."), F.lit(0))
    short, long = (F.when(F.length(a) <= F.length(b), x).otherwise(y) for x, y in ((a, b), (b, a)))
    met = once(characters(short), lambda own: F.aggregate(characters(long), F.lit(0), lambda n, c: F.when(F.get(own, n) == c, n + 1).otherwise(n)))
    lost = F.when(met == F.length(short), F.length(long) - F.length(short))
    within = [once(F.levenshtein(a, b, limit), lambda d: F.when(d >= 0, d)) for limit in (16, 32, 64, 128, 256, 512, 1024, 2048, 4096)]
    return F.coalesce(lost, *within, F.levenshtein(a, b))


def word_distance(a: Column, b: Column) -> Column:
    """Edit distance between the word lists, by writing each distinct word as one character.

    There are characters for a million distinct words of a pair.
    """
    split = lambda x: F.filter(F.split(x, f"{_GAP}+"), lambda w: w != "")

    spell = lambda known, own: F.array_join(F.transform(own, lambda w: character(F.array_position(known, w))), "")
    return once(F.array_distinct(F.concat(split(a), split(b))), lambda known: once(F.struct(spell(known, split(a)).alias("a"), spell(known, split(b)).alias("b")), lambda x: character_distance(x["a"], x["b"])))


def character(number: Column) -> Column:
    """One character for each number from 1 to a million, beginning after U+4E00, without surrogates."""
    code = number + 0x4E00
    return F.decode(F.unhex(F.lpad(F.hex(F.when(code < 0xD800, code).otherwise(code + 0x800)), 8, "0")), "UTF-32")


def character_error_rate(truth: Column, seen: Column) -> Column:
    return F.when(F.length(truth) == 0, F.when(F.length(seen) == 0, 0.0).otherwise(1.0)).otherwise(character_distance(truth, seen) / F.length(truth))


def word_error_rate(truth: Column, seen: Column) -> Column:
    count = lambda x: F.size(F.filter(F.split(x, f"{_GAP}+"), lambda w: w != ""))
    return F.when(count(truth) == 0, F.when(count(seen) == 0, 0.0).otherwise(1.0)).otherwise(word_distance(truth, seen) / count(truth))


def _packet(masked: Column, urls: Column, phones: Column, upper: Column | None = None) -> Column:
    return F.struct(
        urls.alias("urls"),
        url_netlocs(urls).alias("domains"),
        upi_ids(masked).alias("upi_ids"),
        phones.alias("phone_numbers"),
        otp_candidates(masked, phones).alias("otp_candidates"),
        amounts(masked).alias("amounts"),
        bank_names(masked, upper).alias("bank_names"),
        masked.alias("redacted_text"),
    )


def with_entities(df: DataFrame, source: Column, name: str = "entities", normalized: str | None = None) -> DataFrame:
    """Adds all entities of a text: it is healed, ids are masked, and the rest is found in what that leaves.

    With ``normalized`` the text is healed first, and that column gets it with
    white space collapsed.  Each step is a column of its own, so it is computed
    once.  A text that healing leaves as it is is not healed again.
    """
    parts = ("t", "first", "healed", "masked", "whole", "urls", "phones", "upper")
    names = {x: f"__{name}_{x}" for x in parts}
    t, first, healed, masked, whole, urls, phones, upper = (F.col(names[x]) for x in parts)
    steps = {
        "t": source,
        "first": heal_urls(t) if normalized else t,
        "healed": F.when(first == t, first).otherwise(heal_urls(first)) if normalized else heal_urls(first),
        "masked": redacted(healed),
        "whole": F.when((healed == t) & (masked == t), masked).otherwise(heal_urls(masked)),
        "urls": urls_in(whole),
        "phones": phone_numbers(masked),
        "upper": F.upper(masked),
    }
    out = df
    for x, value in steps.items():
        out = out.withColumn(names[x], value)
    out = out.withColumn(name, F.when(t.isNotNull(), _packet(masked, urls, phones, upper)))
    if normalized:
        out = out.withColumn(normalized, collapsed(first))
    return out.drop(*names.values())


def entities(text: Column) -> Column:
    """The same as one column, for short expressions."""
    return once(redacted(heal_urls(text)), lambda masked: once(F.struct(extract_urls(masked).alias("urls"), phone_numbers(masked).alias("phones")), lambda e: _packet(masked, e["urls"], e["phones"])))


def detection(text: Column) -> Column:
    """The normalised text and its entities, from a text that is healed first."""
    return once(heal_urls(text), lambda healed: F.struct(collapsed(healed).alias("normalized_text"), entities(healed).alias("entities")))
