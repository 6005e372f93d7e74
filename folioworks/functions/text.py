"""Messages, sizes and small text checks as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioworks import messages as M
from folioworks.functions.names import trim

MESSAGE_MAX = 512
SECTION = r"(?i)Video\s+(\d+)\s*-\s*([^\n:]+):"


def truncate_message(message: Column) -> Column:
    """Fit a message into 512 characters, ending with an ellipsis when cut."""
    return F.when(F.length(message) > MESSAGE_MAX,
                  F.concat(F.substring(message, 1, MESSAGE_MAX - 1), F.lit("…"))).otherwise(message)


def mismatch_reason(declared: Column, detected: Column, reason: Column) -> Column:
    """Why a file's content is not what its name claims."""
    return (F.when(detected == "unsafe", F.concat(F.lit(M.UNSAFE_FILE), reason))
            .when(detected == "corrupt", F.lit(M.FILE_DAMAGED))
            .otherwise(F.concat(F.lit(M.WRONG_TYPE), declared,
                                F.lit(M.WRONG_TYPE_FOUND), detected)))


def duplicate_upload_message(name: Column) -> Column:
    """Refusal of a name and size that the library already holds."""
    return F.concat(F.lit(M.DUPLICATE), name, F.lit(M.ALREADY_UPLOADED))


def duplicate_queue_message(name: Column) -> Column:
    """Refusal of a file that is already waiting."""
    return F.concat(F.lit(M.DUPLICATE), name, F.lit(M.ALREADY_QUEUED))


def is_duplicate_message(message: Column) -> Column:
    """True for any text that speaks of a duplicate; NULL counts as no."""
    return F.coalesce(F.contains(F.lower(message), F.lit("duplicate")), F.lit(False))


def any_duplicate_error(errors: Column) -> Column:
    """True if one of several messages speaks of a duplicate."""
    return F.coalesce(F.exists(errors, is_duplicate_message), F.lit(False))


def quotient(number: Column, divisor: int) -> Column:
    """Exact integer quotient of a non-negative BIGINT."""
    number = number.cast("bigint")
    return ((number - number % divisor) / divisor).cast("bigint")


def format_bytes(size: Column) -> Column:
    """Human size: whole bytes, else one decimal (half up, in integer arithmetic) in KB, MB or GB."""
    def scaled(power: int, unit: str) -> Column:
        base = 1024 ** power
        tenths = quotient(size * 20 + base, 2 * base)
        return F.concat(quotient(tenths, 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(unit))
    return (F.when(size <= 0, F.lit("0 B"))
            .when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
            .when(size < 1024 ** 2, scaled(1, " KB"))
            .when(size < 1024 ** 3, scaled(2, " MB"))
            .otherwise(scaled(3, " GB")))


def video_sections(text: Column) -> Column:
    """Every `Video N - title:` of a text as array<struct<id, index, title>>, in order."""
    numbers = F.regexp_extract_all(text, F.lit(SECTION), F.lit(1))
    titles = F.regexp_extract_all(text, F.lit(SECTION), F.lit(2))
    pairs = F.arrays_zip(numbers.alias("number"), titles.alias("title"))
    return F.transform(pairs, lambda pair, at: F.struct(
        F.concat(F.lit("video-"), pair["number"], F.lit("-"), at.cast("string")).alias("id"),
        pair["number"].cast("bigint").alias("index"), trim(pair["title"]).alias("title")))


def is_blank(text: Column) -> Column:
    """True when nothing but space is left."""
    return trim(text) == ""


def empty_error(text: Column, kind: str) -> Column:
    """Client message for a document without any text, or NULL."""
    message = M.EMPTY_HTML if kind == "html" else M.EMPTY_DOCUMENT
    return F.when(is_blank(text), message)
