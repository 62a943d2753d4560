"""Column functions on notice text, codes and machine replies."""

from __future__ import annotations

from collections.abc import Iterable
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticewing import domain

# A run of ASCII capitals that is a whole word: no letter, digit or underscore on either side.
_WORD = r"(?<![\p{L}\p{N}_])[A-Z]{2,}+(?![\p{L}\p{N}_])"
# TF-IDF token: two or more word characters.
_TERM = r"[\p{L}\p{N}_]{2,}"


def strip(c: Column) -> Column:
    """Drop white space of every kind, newlines included, from both ends."""
    return F.btrim(c, F.lit(" \t\n\r\x0b\x0c"))


def is_blank(c: Column) -> Column:
    """Null, empty or only white space."""
    return F.coalesce(~c.rlike(r"\S"), F.lit(True))


def strip_enum(c: Column) -> Column:
    """The value behind the printed name of its enumeration."""
    return F.replace(F.replace(c, F.lit(domain.CLASSIFICATION_PREFIX), F.lit("")), F.lit(domain.TYPE_PREFIX), F.lit(""))


def null_if_blank(c: Column, tokens: Iterable[str] = ("", "None", "\\N", "NaN")) -> Column:
    """Null for any spelling of a missing value."""
    return F.when(~c.isin(*tokens), c)


def qcode_flag(c: Column) -> Column:
    """'Has Q-Code' or 'No Q-Code'."""
    return F.when(null_if_blank(c, ("", "None")).isNotNull(), "Has Q-Code").otherwise("No Q-Code")


def char_set(c: Column) -> Column:
    """'NBO' -> ['N', 'B', 'O'], every character once."""
    return F.array_distinct(F.filter(F.split(c, ""), lambda x: x != ""))


def iso_ts(c: Column) -> Column:
    """ISO-8601 text to timestamp, null when it is not one."""
    return F.when(c.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:?\d\d)?$"), F.try_to_timestamp(c))


def effective_end(c: Column) -> Column:
    """Struct of the end time and a permanence flag ('PERM')."""
    permanent = F.coalesce(c == domain.PERMANENT, F.lit(False))
    return F.struct(iso_ts(c).alias("effective_end"), permanent.alias("is_permanent"))


def text_head(c: Column, max_lines: int | None = None) -> Column:
    """First `max_lines` lines, with a '...' line only when something was cut."""
    if max_lines is None:
        return c
    if int(max_lines) <= 0:
        raise ValueError("max_lines must be a positive integer")
    lines = F.split(c, "\n", -1)
    head = F.concat_ws("\n", F.slice(lines, 1, int(max_lines)))
    return F.when(F.size(lines) > int(max_lines), F.concat(head, F.lit("\n..."))).when(c.isNotNull(), c)


def word_count(c: Column) -> Column:
    """Number of white-space separated words; null for null text."""
    stripped = strip(c)
    return F.when(c.isNull(), None).when(stripped == "", 0).otherwise(F.size(F.split(stripped, r"\s+")))


def words(c: Column) -> Column:
    """Upper-case ASCII words of two letters or more, stopwords included."""
    return F.regexp_extract_all(F.upper(c), F.lit(_WORD), F.lit(0))


def is_stopword(word: Column, stopwords: Iterable[str] = domain.STOPWORDS) -> Column:
    return word.isin(*[w.upper() for w in stopwords])


def tokens(c: Column, stopwords: Iterable[str] = domain.STOPWORDS) -> Column:
    """Words of `c` without stopwords, in text order."""
    return F.filter(words(c), lambda w: ~is_stopword(w, stopwords))


def fold_accents(c: Column) -> Column:
    """Replace accented Latin letters by their base letter."""
    import unicodedata

    plain: dict[str, str] = {}
    for code in range(0xC0, 0x250):
        base = unicodedata.normalize("NFKD", chr(code))
        base = "".join(ch for ch in base if not unicodedata.combining(ch))
        if len(base) == 1 and base != chr(code):
            plain[chr(code)] = base
    # plain ASCII has as many bytes as letters and nothing to replace
    return F.when(F.octet_length(c) == F.char_length(c), c).otherwise(F.translate(c, "".join(plain), "".join(plain.values())))


def unigrams(c: Column) -> Column:
    """Tokens of two or more word characters of the folded lower-case text, in text order."""
    return F.regexp_extract_all(fold_accents(F.lower(c)), F.lit(_TERM), F.lit(0))


def fill(template: str, **values: Column | str) -> Column:
    """The template with its {names} replaced by columns or constants."""
    parts: list[Column] = []
    for literal, name, _spec, _conversion in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name:
            value = values[name]
            parts.append(F.lit(value) if isinstance(value, str) else value.cast("string"))
    return F.concat(*parts)


def prompt_text(c: dict[str, Column]) -> Column:
    """The per-notice question put to a labelling service; `c` maps field name to column, null prints 'None'."""
    shown = {name: F.coalesce(value.cast("string"), F.lit("None")) for name, value in c.items()}
    for coded in ("type", "classification"):
        shown[coded] = strip_enum(shown[coded])
    return fill(domain.PROMPT, **shown)


def parse_reply(c: Column) -> Column:
    """Struct (criticality, score, reason, ok) of a labelling reply.

    An absent key takes its default; a key of the wrong type makes the whole reply a failed attempt.
    """
    body = F.regexp_replace(F.regexp_replace(strip(c), r"^```json\s*", ""), r"\s*```$", "")
    reply = F.try_parse_json(body)

    def part(key: str) -> tuple[Column, Column]:
        value = F.try_variant_get(reply, f"$.{key}", "variant")
        return value, F.schema_of_variant(value)

    _, level_type = part("criticality")
    _, score_type = part("score")
    _, reason_type = part("reason")
    level = F.upper(F.try_variant_get(reply, "$.criticality", "string"))
    number = F.try_variant_get(reply, "$.score", "double")
    digits = F.try_variant_get(reply, "$.score", "string").try_cast("bigint").cast("double")
    score = (
        F.when(score_type.isNull(), F.lit(0.0))
        .when(score_type == "STRING", digits)
        .when(score_type.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), number)
        .when(score_type == "BOOLEAN", F.when(F.try_variant_get(reply, "$.score", "boolean"), 1.0).otherwise(0.0))
    )
    ok = (
        F.coalesce(F.schema_of_variant(reply).startswith("OBJECT"), F.lit(False))
        & (level_type.isNull() | (level_type == "STRING"))
        & score.isNotNull()
        & (reason_type.isNull() | (reason_type == "STRING"))
    )
    known = F.when(level.isin(*domain.LEVELS), level).otherwise("INFO")
    clamped = F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0)).cast("int")
    reason = F.left(F.coalesce(F.try_variant_get(reply, "$.reason", "string"), F.lit("")), F.lit(200))
    return F.struct(
        F.when(ok, known).alias("criticality"),
        F.when(ok, clamped).alias("score"),
        F.when(ok, reason).alias("reason"),
        ok.alias("ok"),
    )


def level_order(c: Column, levels: Iterable[str] = domain.LEVELS) -> Column:
    """0 for the most critical level, counting up; null for an unknown one."""
    out = F.lit(None).cast("int")
    for i, level in enumerate(levels):
        out = F.when(c == level, i).otherwise(out)
    return out


def preview(c: Column, n: int) -> Column:
    return F.left(c, F.lit(n))


def pct(part: Column, whole: Column, dp: int = 1) -> Column:
    """Percentage, half-even; 0 for an empty whole."""
    return F.when(whole != 0, F.bround(part * 100.0 / whole, dp)).otherwise(0.0)


def to_number(c: Column, kind: str = "double") -> Column:
    """Number, or null when the text is not one."""
    return c.try_cast(kind)
