"""Column builders for text: tokens, shapes, the structured-text test, and name normalisation."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The words that prose is full of.
STOPWORDS = [
    "a", "an", "the", "and", "or", "of", "in", "on", "to", "for", "with", "by", "at", "from", "as", "is", "are", "was", "were", "be", "have", "has", "had",
    "we", "you", "they", "he", "she", "it", "that", "this", "these", "those",
]
#: Blanks are those of Unicode and the separators 1C to 1F.
_BLANK = r"\s\x1C-\x1F"
#: A word's core runs from its first to its last letter or number; all other characters are tokens of their own.
TOKEN = rf"[\p{{L}}\p{{N}}](?:[^{_BLANK}]*[\p{{L}}\p{{N}}])?|[^{_BLANK}]"
#: Decimal digits, and the other characters that count as digits (superscripts, circled and the like).
DIGIT = (
    r"[\p{Nd}\x{B2}-\x{B3}\x{B9}\x{1369}-\x{1371}\x{19DA}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}\x{2460}-\x{2468}\x{2474}-\x{247C}\x{2488}-\x{2490}\x{24EA}"
    r"\x{24F5}-\x{24FD}\x{24FF}\x{2776}-\x{277E}\x{2780}-\x{2788}\x{278A}-\x{2792}\x{10A40}-\x{10A43}\x{10E60}-\x{10E68}\x{11052}-\x{1105A}\x{11F50}-\x{11F59}\x{16AC0}-\x{16AC9}\x{1E4F0}-\x{1E4F9}\x{1F100}-\x{1F10A}]"
)
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\x{2028}\x{2029}]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once however often use names it."""
    return F.transform(F.array(value), use)[0]


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^[{_BLANK}]+|[{_BLANK}]+\z", "")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?U){TOKEN}"), F.lit(0))


def lines(text: Column) -> Column:
    """Stripped lines that aren't blank."""
    return F.filter(F.transform(F.split(text, LINE_BREAK), stripped), lambda x: x != "")


def numberish(token: Column) -> Column:
    return token.rlike(DIGIT)


def shape(token: Column) -> Column:
    """D with a digit, W if all letters (asked first, as most tokens are), else P."""
    return F.when(token.rlike(r"^\p{L}+\z"), "W").when(numberish(token), "D").otherwise("P")


def line_shape(line: Column) -> Column:
    return F.transform(tokens(line), shape)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def structured_text(text: Column, dr_thresh: float = 0.36, sw_thresh: float = 0.03, ls_thresh: float = 0.88, min_lines: int = 3) -> Column:
    """STRUCT<is_structured, digit_ratio, stopword_ratio, sentence_end_ratio, line_similarity> of a text (null: empty).

    A line's tokens are found once: line breaks are blanks, so together they are the text's.
    """

    def split(rows: Column) -> Column:
        return let(F.struct(rows.alias("lines"), F.transform(rows, tokens).alias("tokens")), shaped)

    def shaped(x: Column) -> Column:
        return let(F.struct(x["lines"].alias("lines"), F.flatten(x["tokens"]).alias("tokens"), F.transform(x["tokens"], lambda line: F.transform(line, shape)).alias("shapes")), scored)

    def scored(x: Column) -> Column:
        k, n = F.size(x["lines"]), F.size(x["tokens"])
        digits = F.size(F.filter(F.flatten(x["shapes"]), lambda s: s == "D"))
        stops = F.size(F.filter(x["tokens"], lambda w: F.lower(w).isin(STOPWORDS)))
        ends = F.size(F.filter(x["lines"], lambda line: line.rlike(r"[.!?]\z")))
        alike = let(F.transform(x["shapes"], F.array_distinct), similar)
        return let(F.when((k >= min_lines) & (n > 0), F.struct((digits / n).alias("d"), (stops / n).alias("s"), (ends / k).alias("e"), alike.alias("l"))), decided)

    def similar(sets: Column) -> Column:
        """The mean similarity of lines that follow one another."""
        pairs = F.zip_with(F.slice(sets, 1, F.size(sets) - 1), F.slice(sets, 2, F.size(sets)), jaccard)
        return F.when(F.size(sets) > 1, F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x) / (F.size(sets) - 1)).otherwise(0.0)

    def decided(x: Column) -> Column:
        put = lambda field, name: F.coalesce(x[field], F.lit(0.0)).alias(name)
        flag = F.coalesce((x["d"] >= dr_thresh) | ((x["s"] <= sw_thresh) & (x["l"] >= ls_thresh)), F.lit(False))
        return F.struct(flag.alias("is_structured"), put("d", "digit_ratio"), put("s", "stopword_ratio"), put("e", "sentence_end_ratio"), put("l", "line_similarity"))

    return let(lines(F.coalesce(text, F.lit(""))), split)


@F.pandas_udf(StringType())
def _decomposed(names: pd.Series) -> pd.Series:
    return names.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x))


def normalize_alnum(name: Column) -> Column:
    """Lower case, compatibility decomposition, only a-z, 0-9 and blanks kept, blanks collapsed (one may stay at an end).

    Only names with other than ASCII characters are sent to Python, which alone knows the decomposition.
    """
    low = stripped(F.lower(name))
    plain = F.coalesce(_decomposed(F.when(low.rlike(r"[^\x00-\x7F]"), low)), low)
    return F.regexp_replace(F.regexp_replace(plain, rf"(?U)[^a-z0-9{_BLANK}]", ""), rf"(?U)[{_BLANK}]+", " ")


def normalize_hyphen(name: Column) -> Column:
    """Lower case, hyphens deleted unless beside a digit, blanks collapsed and trimmed, closing brackets cut off the end."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"(?<!\d)-(?!\d)", ""), r"\s+", " ")), r"\)+$", "")


def node_id(name: Column) -> Column:
    return F.upper(F.trim(name))


def types_of(kind: Column) -> Column:
    return F.transform(F.split(kind, ","), lambda t: F.trim(t))


def document_name(name: Column) -> Column:
    return F.replace(name, F.lit("doc_"), F.lit(""))


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?/*$", 1)


def numbers(name: Column) -> Column:
    return F.regexp_extract_all(name, F.lit(r"\d+(?:\.\d+)?"), F.lit(0))


#: The forms of a reference section's heading, and how the next section begins.
_TITLES = "(?:References|Bibliography|Works Cited)"
_SPACED = r"R[\s\\]*E[\s\\]*F[\s\\]*E[\s\\]*R[\s\\]*E[\s\\]*N[\s\\]*C[\s\\]*E[\s\\]*S"
_HEADINGS = "|".join((rf"\*\*{_TITLES}\*\*", rf"#+\s*\**\s*{_TITLES}\**\s*", r"R[\s\\]+EFERENCES\*\*", _SPACED, r"\*\*R\*\*[\s\\]*\*\*EFERENCES\*\*"))
HEADING = rf"(?iumd)(?:(?:^|\n\s*)(?:{_HEADINGS})(?:\s*\n|$))"
SECTION = r"(?ud)\n\s*(?:#+\s+.*|\*\*.*\*\*)"
MARK = "\n\n---References section begin---\n\n---References section end---\n\n"


def isolate_references(text: Column) -> Column:
    """STRUCT<text, references>: the reference section cut out of a text, as its first heading and the next section bound it.

    The heading and the section after it are each looked for once.
    """
    untouched = F.struct(text.alias("text"), F.lit("").alias("references"))

    def headed(heading: Column) -> Column:
        start = F.instr(text, heading)
        return let(F.struct(F.substring(text, F.lit(1), start - 1).alias("before"), heading.alias("heading"), F.substring(text, start + F.length(heading), F.length(text)).alias("rest")), bounded)

    def bounded(x: Column) -> Column:
        return let(F.struct(x["before"].alias("before"), x["heading"].alias("heading"), x["rest"].alias("rest"), F.regexp_instr(x["rest"], F.lit(SECTION)).alias("end")), cut)

    def cut(x: Column) -> Column:
        open_ = x["end"] > 0
        main = F.when(open_, F.concat(x["before"], F.lit(MARK), F.substring(x["rest"], x["end"], F.length(x["rest"])))).otherwise(x["before"])
        entries = F.when(open_, F.substring(x["rest"], F.lit(1), x["end"] - 1)).otherwise(x["rest"])
        return F.struct(stripped(main).alias("text"), stripped(F.concat(x["heading"], entries)).alias("references"))

    return let(F.regexp_substr(text, F.lit(HEADING)), lambda heading: F.when(heading.isNotNull(), headed(heading)).otherwise(untouched))
