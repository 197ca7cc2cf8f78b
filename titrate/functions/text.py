"""Text helpers: Column -> Column, all inside generated code (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROL_AND_SPACE = "".join(chr(c) for c in range(0x21))
MAX_DECIMAL_LENGTH = 48
# Fixed value: the accepted shape of a result number.
BOUNDED_DECIMAL = r"\A[+-]?(?:\d{1,18}(?:\.\d{0,18})?|\.\d{1,18})(?:[eE][+-]?\d{1,3})?\z"
NOT_BLANK = r"\P{javaWhitespace}"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that later expressions use many times, each computed a single time per row.

    Plain projections are merged by the optimizer, which copies their expressions into every use; a one-element
    explode is a step it does not merge across. The expressions stay in a projection of their own below it. Fused with its neighbours it would
    be one method beyond the 8 000 bytes that the JVM compiles, and be interpreted for every row; the ``let`` keeps it unfused, and Spark then
    cuts its code into small methods.
    """
    packed = F.array_repeat(F.struct(*[c.alias(n) for n, c in columns.items()]), let(F.lit(1), lambda n: n))
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, packed.alias("_packed")).select(*kept, F.explode_outer("_packed").alias("_once")).select(
        *kept, *[F.col(f"_once.{n}").alias(n) for n in columns])


def clip(value: Column) -> Column:
    """Strip every character up to U+0020 from both ends (plain ``trim`` strips the space only)."""
    return F.btrim(value, F.lit(CONTROL_AND_SPACE))


def clip_column(value: Column) -> Column:
    """``clip`` of a value that compiled code computes once: most texts need no cut, which their two ends tell without a search for each character."""
    clean = (value == "") | ((value >= "!") & (F.substring(value, -1, 1) >= "!"))
    return F.when(clean, value).otherwise(clip(value))


def unfused(value: Column) -> Column:
    """The value, in a projection of its own that Spark cuts into small methods (see ``computed_once``)."""
    return F.when(let(F.lit(True), lambda t: t), value)


def filled(value: Column) -> Column:
    """The value has a character that is not white space (NULL counts as blank)."""
    return F.coalesce(value.rlike(NOT_BLANK), F.lit(False))


def blank_to_null(value: Column) -> Column:
    return F.when(filled(value), value)


def blank_to_null_column(value: Column) -> Column:
    """``blank_to_null`` of a column: most texts begin with a printing ASCII character, and need no search."""
    return F.when((value >= "!") & (value < "\x7f"), value).otherwise(blank_to_null(value))


def empty_to_null(value: Column) -> Column:
    return F.when(value != "", value)


def is_bounded_decimal(value: Column) -> Column:
    return F.coalesce((F.length(value) <= MAX_DECIMAL_LENGTH) & value.rlike(BOUNDED_DECIMAL), F.lit(False))


def canonical_number(value: Column, separator: Column | str = ".") -> Column:
    """The number with its configured decimal separator written as a point."""
    sep = F.lit(separator) if isinstance(separator, str) else F.coalesce(separator, F.lit("."))
    return F.when(sep == ".", value).otherwise(F.replace(value, sep, F.lit(".")))


def literal_pattern(text: Column) -> Column:
    """A regular expression that matches the text itself."""
    return F.concat(F.lit("\\Q"), text, F.lit("\\E"))


def pieces(value: Column, delimiter: Column | str) -> Column:
    """Pieces of a delimited text, trailing empty ones kept."""
    if isinstance(delimiter, str):
        # An escaped single character is split without a regular expression.
        return F.split(value, "\\" + delimiter if not delimiter.isalnum() else delimiter)
    return F.split(value, literal_pattern(delimiter))


def part(value: Column, delimiter: Column | str, position: Column | int) -> Column:
    """1-based piece of a delimited text; NULL past the end or for a NULL position."""
    index = F.lit(position - 1) if isinstance(position, int) else position - 1
    return F.get(pieces(value, delimiter), index)


def truncate(value: Column, limit: int) -> Column:
    return F.substring(value, 1, limit)


def error_text(value: Column) -> Column:
    return truncate(value, 1000)


def response_text(value: Column) -> Column:
    return truncate(value, 2000)


def snippet(value: Column) -> Column:
    return truncate(value, 800)


def age_seconds(since: Column, now: Column) -> Column:
    return F.greatest(F.lit(0), F.unix_seconds(now) - F.unix_seconds(since))


def wildcard_regex(pattern: Column) -> Column:
    """Whole-value, case-insensitive pattern in which ``*`` stands for any text."""
    quoted = F.concat(F.lit("\\Q"), F.replace(pattern, F.lit("*"), F.lit("\\E.*\\Q")), F.lit("\\E"))
    return F.concat(F.lit("(?is)\\A"), quoted, F.lit("\\z"))


NEVER = "(?!)"  # a pattern that finds nothing


def compiles(pattern: Column) -> Column:
    """Whether the text is a regular expression; of a dimension's rows, never of each message."""
    return F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), pattern).isNotNull()


def safe_pattern(pattern: Column) -> Column:
    """The pattern, or one that finds nothing where it does not compile; blank stays as it is."""
    return F.when(filled(pattern) & ~compiles(pattern), F.lit(NEVER)).otherwise(pattern)


def glob_regex(glob: Column) -> Column:
    """A file-name glob as an anchored regular expression: ``*`` and ``?`` stay inside one path segment, ``**`` does not, ``[a-c]`` and ``[!a]`` are
    classes, ``{a,b}`` are alternatives (a comma elsewhere is a comma), ``\\`` quotes. A glob that gives no valid expression finds nothing.
    """
    tokens = F.regexp_extract_all(glob, F.lit(r"(?s)\*\*|\\.|\[[^\]]+\]|."), F.lit(0))

    def of_token(token: Column, depth: Column) -> Column:
        body = F.substring(token, F.lit(2), F.length(token) - 2)
        negated = body.startswith("!")
        inner = F.regexp_replace(F.when(negated, F.substring(body, F.lit(2), F.length(body))).otherwise(body), r"([\\\[&^])", r"\\$1")
        last = F.right(token, F.lit(1))
        literal = F.when(last.rlike(r"[\\^$.|?*+()\[\]{}]"), F.concat(F.lit("\\"), last)).otherwise(last)
        return (
            F.when(token == "**", ".*").when(token == "*", "[^/]*").when(token == "?", "[^/]")
            .when((F.length(token) > 2) & token.startswith("["), F.concat(F.when(negated, "(?!/)[^").otherwise("(?!/)["), inner, F.lit("]")))
            .when(token == "{", "(?:").when((token == "}") & (depth > 0), ")").when((token == ",") & (depth > 0), "|").otherwise(literal)
        )

    def step(acc: Column, token: Column) -> Column:
        move = F.when(token == "{", 1).when((token == "}") & (acc["depth"] > 0), -1).otherwise(0)
        return F.struct(F.concat(acc["out"], of_token(token, acc["depth"])).alias("out"), (acc["depth"] + move).alias("depth"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("depth"))
    return F.aggregate(tokens, start, step, lambda acc: safe_pattern(F.concat(F.lit("\\A(?:"), acc["out"], F.lit(")\\z"))))
