"""Column functions over the text of document blocks; no UDFs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, spelled out, for regular expressions of any engine.
WS = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
CJK = r"[\x{3400}-\x{9FFF}]"
#: Fixed patterns of numbering, captions and labels.
CHAPTER = r"^第[一二三四五六七八九十百]+章(\s|$)"
PARENTHESIZED = r"^[（(][0-9]+[）)]"
ENUMERATION = r"^[一二三四五六七八九十百]+[、.]"
DECIMAL = r"^([0-9]+(\.[0-9]+)*)"
SECOND = r"^[0-9]+[.、]?\s*[^0-9.]"
THIRD = r"^[0-9]+\.[0-9]+([^.]|$)"
FIGURE = r"(?i)^(图\s*[0-9]|Fig(ure)?\.?\s*[0-9])"
TABLE = r"(?i)^(表\s*[0-9]|Table\s*[0-9])"
CAPTION_PREFIX = r"(?i)^((图|表)\s*([0-9]+(\s*[-－—–]\s*[0-9]+)?\s*)?|(Fig(ure)?\.?|Table)\s*([0-9]+(\s*[-－—–]\s*[0-9]+)?\s*)?)"
CAPTION_NUMBER = r"(?i)^(图|表|Fig(ure)?\.?|Table)\s*([0-9]+(\s*[-－—–]\s*[0-9]+)?)"
LABELS = {
    "keywords_zh": r"^关键词\s*[：:]\s*",
    "keywords_en": r"^(KEY\s*WORDS|KEYWORDS|Key\s*words)\s*[：:]\s*",
    "abstract_zh": r"^摘\s*要\s*[：:]\s*",
    "abstract_en": r"(?i)^Abstract\s*[：:]\s*",
}
#: Left-over markers of unfilled templates.
PLACEHOLDERS = ("在此填写", "TODO", "{{", "XXXXX")


def without(c: Column, pattern: str) -> Column:
    return F.regexp_replace(c, pattern, "")


def trimmed(c: Column) -> Column:
    return without(without(c, f"^{WS}+"), f"{WS}+$")


#: Full case folding by one version of Unicode, Python's: of one character, and of several. Lower case isn't asked for, as the JVM's may be of another.
FOLD_ONE = {c: f for c in map(chr, range(0x20000)) if (f := c.casefold()) != c and len(f) == 1}
FOLD_SEVERAL = {c: f for c in map(chr, range(0x20000)) if len(f := c.casefold()) > 1}
#: White space as in WS, character by character.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c), with c worked out once for each row, also where the optimizer doesn't share it."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def case_folded(c: Column, spaces: str = "") -> Column:
    """Full case folding, as of the final sigma, the sharp s and ligatures; the characters of `spaces` become spaces.

    One table does all that folds to one character and leaves out what folds to several but the sharp s; where the text
    is shorter then, those are replaced one by one.
    """
    rare = {char: fold for char, fold in FOLD_SEVERAL.items() if char != "ß"}
    source, target = "".join(FOLD_ONE) + spaces, "".join(FOLD_ONE.values()) + " " * len(spaces)
    several = F.translate(c, source, target)
    for char, fold in rare.items():
        several = F.replace(several, F.lit(char), F.lit(fold))
    # what isn't in the target goes
    one = once(F.translate(c, source + "".join(rare), target), lambda x: F.when(F.char_length(x) == F.char_length(c), x).otherwise(several))
    return F.replace(one, F.lit("ß"), F.lit("ss"))


def norm_text(c: Column) -> Column:
    """Comparable text: no white space, case folded."""
    return F.replace(case_folded(c, SPACES), F.lit(" "), F.lit(""))


def match_norm(c: Column) -> Column:
    """Matching text: full-width colons as colons, no white space, no empty boxes."""
    return without(F.translate(c, "：□", ":"), WS)


def leader_norm(c: Column) -> Column:
    """Comparable text without dot leaders."""
    return without(norm_text(c), r"\.{3,}|…{2,}|·{3,}")


def values_equal(a: Column, b: Column) -> Column:
    """Null equals null alone; texts compare as comparable text."""
    return norm_text(a).eqNullSafe(norm_text(b))


def numbering_shape(c: Column) -> Column:
    t = trimmed(c)
    parts = F.least(F.regexp_count(F.regexp_extract(t, DECIMAL, 1), F.lit(r"\.")) + 1, F.lit(4))
    return (
        F.when(t.rlike(CHAPTER), "chinese_chapter")
        .when(t.rlike(PARENTHESIZED), "parenthesized_integer")
        .when(t.rlike(ENUMERATION), "chinese_enumeration")
        .when(t.rlike(DECIMAL), F.concat(F.lit("decimal_"), parts.cast("string"), F.lit("_component")))
        .otherwise("none")
    )


def script_lang(c: Column, mode: str = "mixed_letters") -> Column:
    """zh, en, mixed or und. Mode 'vertical_tab' calls only texts with a vertical tab mixed, and zh comes before en."""
    zh, en = c.rlike(CJK), c.rlike("[A-Za-z]")
    if mode == "vertical_tab":
        return F.when(c.contains("\x0b"), "mixed").when(zh, "zh").when(en, "en").otherwise("und")
    return F.when(zh & en, "mixed").when(zh, "zh").when(en, "en").otherwise("und")


def strip_label(c: Column, kind: str) -> Column:
    return trimmed(without(c, LABELS[kind])) if kind in LABELS else trimmed(c)


def caption_title(c: Column) -> Column:
    """Each part between vertical tabs without its caption label and number."""
    return F.array_join(F.transform(F.split(c, "\x0b"), lambda x: trimmed(without(trimmed(x), CAPTION_PREFIX))), "\x0b")


def caption_number(c: Column) -> Column:
    found = F.regexp_extract(c, CAPTION_NUMBER, 3)
    return F.when(found != "", F.trim(F.regexp_replace(found, r"\s*[-－—–]\s*", "-")))


def classify_block(text: Column, kind: Column, content_type: Column) -> Column:
    """What a block is; the first rule that fits wins, a blank one is null."""

    def told(t: Column) -> Column:
        return (
            F.when(t == "", F.lit(None))
            .when(t.rlike(FIGURE), "body.figure.caption")
            .when(t.rlike(TABLE), "body.table.caption")
            .when(t.rlike(CHAPTER), "body.heading.level1")
            .when((F.length(t) <= 100) & t.rlike(THIRD), "body.heading.level3")
            .when((F.length(t) <= 80) & t.rlike(SECOND), "body.heading.level2")
            .when(t.rlike(PARENTHESIZED), "body.numbered_list_item")
            .otherwise("body.paragraph")
        )

    return F.when(kind == "table", "body.table").when(content_type == "equation", "body.equation").otherwise(once(trimmed(text), told))


def stable_id(prefix: str, **identity: Column) -> Column:
    """prefix and 24 hex digits of the SHA-256 over the identity as JSON with sorted keys."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.to_json(F.struct(*[v.alias(k) for k, v in sorted(identity.items())])), 256), 1, 24))


def semantic_digest(**parts: Column) -> Column:
    """SHA-256 over named parts; lists count as sets, so order and repetition don't change it."""
    return F.sha2(F.to_json(F.struct(*[v.alias(k) for k, v in sorted(parts.items())])), 256)


def as_set(c: Column) -> Column:
    return F.sort_array(F.array_distinct(c))


def half_points(c: Column) -> Column:
    return c.try_cast("int") / 2


def twips(c: Column) -> Column:
    return c.try_cast("int") / 20


def on_off(present: Column, value: Column) -> Column:
    """Null if the element is absent, false for 0, false and off, else true."""
    return F.when(present, ~F.coalesce(F.lower(value).isin("0", "false", "off"), F.lit(False)))


def occurrences(hay: Column, needle: Column) -> Column:
    """How often a non-empty string occurs, without overlaps."""
    return ((F.length(hay) - F.length(F.replace(hay, needle, F.lit("")))) / F.length(needle)).cast("long")


def contains_in_order(hay: Column, pieces: Column) -> Column:
    """Whether the pieces occur one after the other without overlaps."""
    step = F.aggregate(pieces, F.lit(1), lambda at, x: F.when(at == 0, F.lit(0)).otherwise(F.when(F.call_function("locate", x, hay, at) > 0, F.call_function("locate", x, hay, at) + F.length(x)).otherwise(F.lit(0))))
    return step > 0


def masked(text: Column, spans: Column, mark: str = "<SLOT>") -> Column:
    """Text with each of the ordered, disjoint spans (start, stop from 0) replaced by the mark; spans are clipped."""
    n = F.length(text)
    start = lambda s: F.least(F.greatest(s["start"], F.lit(0)), n)
    stop = lambda s: F.least(F.greatest(s["stop"], F.lit(0)), n)
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    done = F.aggregate(spans, zero, lambda a, s: F.struct(F.concat(a["out"], text.substr(a["at"] + 1, start(s) - a["at"]), F.lit(mark)).alias("out"), stop(s).alias("at")))
    return F.concat(done["out"], text.substr(done["at"] + 1, n))


def span_overlaps(start: Column, stop: Column, low: Column, high: Column) -> Column:
    """Whether two spans share a character; an empty span lies in another if its place does."""
    return F.when(start == stop, (low <= start) & (start <= high)).otherwise(F.when(low == high, (start <= low) & (low <= stop)).otherwise((start < high) & (low < stop)))


def search_terms(c: Column, stop_words: list[str], aliases: dict[str, str]) -> Column:
    """Distinct search terms in order: Latin words and CJK runs; CJK runs become all aliases they hold, longest first."""
    raw = F.filter(F.regexp_extract_all(F.lower(c), F.lit(rf"([a-z0-9]+|{CJK}+)"), F.lit(1)), lambda x: ~x.isin(*stop_words))
    ordered = sorted(aliases.items(), key=lambda x: -len(x[0]))
    table = F.create_map(*[F.lit(v) for pair in ordered for v in pair])
    held = lambda t: F.array_compact(F.array(*[F.when(t.contains(a), F.lit(b)) for a, b in ordered]))
    terms = F.transform(raw, lambda t: F.when(t.rlike(f"^{CJK}+$"), F.when(F.size(held(t)) > 0, held(t)).otherwise(F.array(t))).otherwise(F.array(F.coalesce(table[t], t))))
    return F.array_distinct(F.flatten(terms))


def redacted(c: Column, secrets: list[str]) -> Column:
    for s in secrets:
        if s:
            c = F.replace(c, F.lit(s), F.lit("<redacted>"))
    return c


def migrated(c: Column, mapping: dict[str, str]) -> Column:
    """A field id, or its new name."""
    return F.coalesce(F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])[c], c)
