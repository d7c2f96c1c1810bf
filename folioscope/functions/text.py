"""Keys, classification and repair of span texts as Column expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope import config
from folioscope.functions.columns import let, present
from folioscope.functions.geometry import is_annotation_color

LOST, SOFT = "\ufffd", "\u00ad"


def composed_letters() -> tuple[str, str]:
    """Letters that are a plain one with marks (in their composed form), and the plain ones."""
    marked, bare = [], []
    for c in map(chr, range(0xC0, 0x2000)):
        base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if base != c and len(base) == 1:
            marked.append(c)
            bare.append(base)
    return "".join(marked), "".join(bare)


MARKED, BARE = composed_letters()
#: White space in and beyond ASCII.
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def label_key(text: Column) -> Column:
    return squeeze(F.regexp_replace(F.lower(text), "[^a-z0-9 ]+", " "))


def field_key(text: Column) -> Column:
    return squeeze(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[.#:()\[\]]", " "))


def mark_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(squeeze(F.regexp_replace(F.lower(text), "[^a-z0-9: ]", " ")), "^:+|:+$", ""))


def strip_accents(text: Column) -> Column:
    """The text without marks above and below letters, composed or combining."""
    return F.regexp_replace(F.translate(text, MARKED, BARE), r"\p{Mn}", "")


def legend_key(text: Column) -> Column:
    return squeeze(F.regexp_replace(strip_accents(F.lower(F.coalesce(text, F.lit("")))), r"[^a-z0-9%/:.\s-]", " "))


def phrase_key(phrase: str) -> str:
    """legend_key() of a constant."""
    return " ".join(re.sub(r"[^a-z0-9%/:.\s-]", " ", phrase).split())


def compare_key(text: Column) -> Column:
    return F.lower(squeeze(text))


def within_one_edit(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) >= 0


def numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(config.DIMENSION_NUMBER), F.lit(0)), lambda x: x.cast("double"))


def canonical(text: Column, labels=config.FIELD_LABELS) -> Column:
    """The canonical field of a label: exact alias first, then a whole-word start or end, then a substring; by order in each."""

    def found(k: Column) -> Column:
        tiers = [[F.when(k == a, c) for a, c in labels], [F.when(k.startswith(a + " ") | k.endswith(" " + a), c) for a, c in labels], [F.when(k.contains(a), c) for a, c in labels]]
        return F.coalesce(*[x for t in tiers for x in t])

    return let(field_key(text), found)


def header_labels(key: Column) -> Column:
    """Canonical header labels whose alias stands in a label key, distinct, in order."""
    return let(key, lambda k: F.array_distinct(present([F.when(k.contains(a), c) for a, c in config.HEADER_LABELS])))


def is_header_label(key: Column) -> Column:
    """Whether a label key is an alias and nothing else."""
    return key.isin([a for a, _ in config.HEADER_LABELS])


def is_dimension(text: Column) -> Column:
    return strip(text).rlike(config.DIMENSION_PATTERN)


def is_arrow(text: Column) -> Column:
    return strip(text).isin(config.ARROWS)


#: A term, or a term, a blank and the rest of a short suffix, as one pattern over the key.
MARK_PATTERN = f"^(?:{'|'.join(config.MARK_TERMS)})(?: .{{0,{config.MARK_SUFFIX - 1}}})?$"


def is_mark(text: Column) -> Column:
    """A production mark: a term, or a term and a short suffix."""
    return mark_key(text).rlike(MARK_PATTERN)


def is_annotation(text: Column, color: Column, in_header: Column) -> Column:
    return ~in_header & ((is_dimension(text) & is_annotation_color(color)) | is_arrow(text))


def is_mark_near_miss(text: Column, color: Column) -> Column:
    return strip(text).rlike(config.MARK_SHAPE) & is_annotation_color(color) & ~is_mark(text)


def is_dimension_near_miss(text: Column, color: Column, in_header: Column) -> Column:
    return ~in_header & is_dimension(text) & ~is_annotation_color(color)


def decode_ligatures(text: Column) -> Column:
    for bad, good in config.LIGATURES:
        text = F.replace(text, F.lit(bad), F.lit(good))
    return text


def entry(bad: Column, good: Column, n: Column, kind: str, confidence: str) -> Column:
    """One line of a repair log."""
    return F.struct(bad.alias("from"), good.alias("to"), n.cast("int").alias("count"), F.lit(kind).alias("type"), F.lit(confidence).alias("confidence"))


def code_point(c: str) -> str:
    return f"U+{ord(c):04X}"


def ligature_log(text: Column) -> Column:
    """Log lines of every ligature character in the text, in order of replacement."""
    return present([F.when(F.instr(text, bad) > 0, entry(F.lit(code_point(bad)), F.lit(good), F.length(text) - F.length(F.replace(text, F.lit(bad), F.lit(""))), "ligature_cid", "high")) for bad, good in config.LIGATURES])


def unknown_code_points(text: Column) -> Column:
    """Distinct characters of a decoded text beyond ASCII that nothing accounts for, as U+XXXX in order."""
    odd = F.array_distinct(F.filter(F.split(text, ""), lambda c: (c != "") & (F.octet_length(c) > 1) & ~F.instr(F.lit(config.EXPECTED), c).cast("boolean")))
    # the code point of a character, from its UTF-32 bytes
    number = lambda c: F.regexp_replace(F.hex(F.encode(c, "UTF-32")), "^0{1,4}", "")
    return F.array_sort(F.transform(odd, lambda c: F.concat(F.lit("U+"), number(c))))


def plausible(text: Column) -> Column:
    """Whether every character may stand in a text of Latin letters."""
    return text.rlike(config.PLAUSIBLE)


def mojibake_runs(text: Column) -> Column:
    """Foreign runs in order: (run, fixed), fixed being the UTF-8 bytes that GBK hid, or the run itself where these are not valid and plausible.

    Needs spark.sql.legacy.javaCharsets and spark.sql.legacy.codingErrorAction; see enable_gbk()."""

    def fixed(run: Column) -> Column:
        def checked(out: Column) -> Column:
            fits = ~out.contains(LOST) & plausible(out) & (F.decode(F.encode(out, "UTF-8"), "GBK") == run)
            return F.struct(run.alias("run"), F.when(fits, out).otherwise(run).alias("fixed"))

        return let(F.decode(F.encode(run, "GBK"), "UTF-8"), checked)

    return F.transform(F.regexp_extract_all(text, F.lit(f"({config.FOREIGN})"), F.lit(1)), fixed)


def mended(text: Column, runs: Column) -> Column:
    parts = F.split(text, config.FOREIGN)
    return F.array_join(F.transform(F.arrays_zip(parts.alias("p"), runs.alias("r")), lambda x: F.concat(F.coalesce(x["p"], F.lit("")), F.coalesce(x["r"]["fixed"], F.lit("")))), "")


def repair_mojibake(text: Column) -> Column:
    """Each foreign run read as the UTF-8 bytes that GBK hid, if these are valid and plausible."""
    return F.when(text.rlike(config.FOREIGN), mended(text, mojibake_runs(text))).otherwise(text)


def mojibake_log(text: Column) -> Column:
    changed = F.filter(mojibake_runs(text), lambda r: r["run"] != r["fixed"])
    return F.transform(changed, lambda r: entry(r["run"], r["fixed"], F.lit(None), "mojibake_gbk", "high"))


def enable_gbk(spark) -> None:
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    spark.conf.set("spark.sql.legacy.codingErrorAction", "true")


LOG = "array<struct<from:string,to:string,count:int,type:string,confidence:string>>"


def known_words(state: Column) -> Column:
    """(text, log) after all known words, one after another."""
    words = F.array(*[F.struct(F.lit(a).alias("bad"), F.lit(b).alias("good")) for a, b in config.KNOWN_WORDS])

    def step(s: Column, w: Column) -> Column:
        more = F.concat(s["log"], F.array(entry(w["bad"], w["good"], F.lit(None), "known_word", "high")))
        return F.when(s["text"].contains(w["bad"]), F.struct(F.replace(s["text"], w["bad"], w["good"]).alias("text"), more.alias("log"))).otherwise(s)

    return F.aggregate(words, state, step)


def lost_glyphs(state: Column) -> Column:
    """A lone lost glyph before a letter, after one or at a word's start, is read as ti; what is left is beyond repair."""
    inner = F.regexp_replace(state["text"], rf"(?<=\p{{L}}){LOST}(?=\p{{L}})", "ti")
    tried = F.regexp_replace(inner, rf"(?<![\p{{L}}{LOST}]){LOST}(?=\p{{L}})", "ti")

    def logged(t: Column) -> Column:
        log = F.concat(
            state["log"], present([F.when(t != state["text"], entry(F.lit("U+FFFD"), F.lit("ti"), F.lit(None), "ligature_ti", "guessed"))]),
            present([F.when(t.contains(LOST), entry(F.lit("U+FFFD"), F.lit(None).cast("string"), F.lit(None), "unrecoverable", "failed"))]),
        )
        return F.struct(t.alias("text"), log.alias("log"))

    return let(tried, logged)


def soft_hyphens(state: Column) -> Column:
    """Soft hyphens between word characters are read as ti, and then others stay; without any such one, all are removed."""

    def logged(t: Column) -> Column:
        read = F.struct(t.alias("text"), F.concat(state["log"], F.array(entry(F.lit("U+00AD"), F.lit("ti"), F.lit(None), "soft_hyphen_ligature", "guessed"))).alias("log"))
        gone = F.struct(F.replace(t, F.lit(SOFT), F.lit("")).alias("text"), F.concat(state["log"], F.array(entry(F.lit("U+00AD"), F.lit(""), F.lit(None), "soft_hyphen_removed", "high"))).alias("log"))
        return F.when(t != state["text"], read).when(t.contains(SOFT), gone).otherwise(state)

    return let(F.regexp_replace(state["text"], rf"(?U)(?<=\w){SOFT}(?=\w)", "ti"), logged)


def repair(text: Column) -> Column:
    """struct(text, repaired, confidence, log): ligatures, mojibake, known words, lost glyphs and soft hyphens, in this order.

    A text counts as repaired if its log has a line, an unrecoverable glyph included. Confidence is the worst of the lines, or null."""

    def whole(a: Column) -> Column:
        start = F.struct(repair_mojibake(a).alias("text"), F.concat(ligature_log(text), F.when(a.rlike(config.FOREIGN), mojibake_log(a)).otherwise(F.array().cast(LOG))).cast(LOG).alias("log"))
        steps = let(let(let(start, known_words), lost_glyphs), soft_hyphens)
        light = F.struct(a.alias("text"), ligature_log(text).cast(LOG).alias("log"))
        return F.when(a.rlike(f"[{LOST}{SOFT}]") | a.rlike(config.FOREIGN), steps).otherwise(light)

    def judged(s: Column) -> Column:
        has = lambda c: F.exists(s["log"], lambda x: x["confidence"] == c)
        confidence = F.when(has("failed"), "failed").when(has("guessed"), "guessed").when(F.size(s["log"]) > 0, "high")
        return F.struct(s["text"].alias("text"), (F.size(s["log"]) > 0).alias("repaired"), confidence.alias("confidence"), s["log"].alias("log"))

    return let(let(decode_ligatures(text), whole), judged)


def legends(text: Column, house: str = "") -> Column:
    """Legends found in a text, in order of where they stand (equal places by name), each once."""

    def found(k: Column) -> Column:
        hits = []
        for w in config.WARNINGS:
            at = F.when(k.contains(w + ":"), F.locate(w + ":", k)).when(k.contains(w + " :"), F.locate(w + " :", k))
            hits.append(F.when(at.isNotNull(), F.struct(at.alias("at"), F.lit(f"warning_{w.replace(' ', '_')}").alias("id"))))
        for name, phrases in config.LEGENDS:
            at = F.coalesce(*[F.when(F.locate(phrase_key(p), k) > 0, F.locate(phrase_key(p), k)) for p in phrases])
            hits.append(F.when(at.isNotNull(), F.struct(at.alias("at"), F.lit(name).alias("id"))))
        for name, pattern in config.LEGEND_PATTERNS:
            if "{house}" not in pattern or house:
                p = pattern.replace("{house}", house)
                before = F.lit(0) if p.startswith("^") else F.length(F.regexp_extract(k, f"^(.*?)(?:{p})", 1))
                hits.append(F.when(k.rlike(p), F.struct((before + 1).alias("at"), F.lit(name).alias("id"))))
        return F.array_distinct(F.transform(F.array_sort(present(hits)), lambda x: x["id"]))

    return let(legend_key(text), found)
