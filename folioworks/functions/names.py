"""Names: base names, extensions, titles, normal forms, object keys and document ids, as Column expressions.

Everything runs inside whole-stage codegen. The one exception is `normalize`: Spark has neither NFKC nor full case
folding, so rows with characters outside the plain Latin range go through a vectorised function, and only those
rows' text crosses to Python (the others pass NULL).
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folioworks.messages import DOCUMENT_NAMESPACE

# Latin text for which lower-casing plus "ß → ss" equals NFKC + full case folding …
PLAIN_LATIN = r"^[\t-\r\x20-\x7EÀ-ÖØ-öø-ÿ]*$"
# … and the characters a Unicode-aware trim removes.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0  -     　]"


def path_parts(path: Column) -> Column:
    """Components of a slash path, without empty and '.' ones."""
    return F.filter(F.split(path, "/"), lambda part: ~part.isin("", "."))


def base_name(path: Column) -> Column:
    """Last path component ('' when there is none)."""
    return F.coalesce(F.try_element_at(path_parts(path), F.lit(-1)), F.lit(""))


def folder_depth(path: Column) -> Column:
    """How many folders deep a path sits; the root of an absolute path counts as one."""
    return F.size(path_parts(path)) - 1 + F.startswith(path, F.lit("/")).cast("int")


def file_ext(name: Column) -> Column:
    """Lower-case extension of the base name, no dot; a name that only starts with a dot has none."""
    return F.lower(F.regexp_extract(base_name(name), r"(?s)^.+\.([^.]+)$", 1))


def client_ext(name: Column) -> Column:
    """The browser's rule: a trailing alphanumeric run after the last dot, so a bare '.docx' has one; htm is html."""
    ext = F.lower(F.regexp_extract(trim(name), r"(?i)\.([a-z0-9]+)$", 1))
    return F.when(ext == "htm", F.lit("html")).otherwise(ext)


def trim(text: Column) -> Column:
    """Strip every Unicode space from both ends."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def title_of(name: Column) -> Column:
    """Proposed title: the base name without its extension, or the whole trimmed name when nothing is left."""
    base = base_name(name)
    stem = trim(F.coalesce(F.nullif(F.regexp_extract(base, r"(?s)^(.+)\.[^.]+$", 1), F.lit("")), base))
    return F.when(stem != "", stem).otherwise(trim(name))


def fold_text(text: str, drop_punctuation: bool) -> str:
    """NFKC, case fold, optionally punctuation to spaces, then single spaces."""
    folded = unicodedata.normalize("NFKC", text).casefold()
    if drop_punctuation:
        marks = {ch for ch in set(folded) if unicodedata.category(ch)[0] == "P"}
        folded = folded.translate({ord(ch): " " for ch in marks})
    return " ".join(folded.split())


@F.pandas_udf(StringType())
def _fold_title(text: pd.Series) -> pd.Series:
    return text.map(lambda value: fold_text(value, True), na_action="ignore")


@F.pandas_udf(StringType())
def _fold_name(text: pd.Series) -> pd.Series:
    return text.map(lambda value: fold_text(value, False), na_action="ignore")


def normalize(text: Column, drop_punctuation: bool) -> Column:
    """Normal form for comparisons; plain Latin rows stay native, the rest take the vectorised branch."""
    plain = text.rlike(PLAIN_LATIN)
    native = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    if drop_punctuation:
        native = F.regexp_replace(native, r"\p{P}", " ")
    native = F.trim(F.regexp_replace(native, r"[\t-\r ]+", " "))
    folded = (_fold_title if drop_punctuation else _fold_name)(F.when(~plain, text))
    return F.when(plain, native).otherwise(folded)


def title_norm(title: Column) -> Column:
    """Normal form of a title: punctuation counts as space."""
    return normalize(title, True)


def file_name_norm(name: Column) -> Column:
    """Normal form of a file name: punctuation kept."""
    return normalize(name, False)


def _name_uuid(name: Column) -> Column:
    """Version 5 UUID of a name in the fixed namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(DOCUMENT_NAMESPACE.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4),
                       F.concat(F.lit("5"), F.substring(digest, 14, 3)),
                       F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def document_id(staged_id: Column) -> Column:
    """Id of the document a candidate becomes, so that a repeated commit yields the same document."""
    return _name_uuid(staged_id)


def staged_id(file_id: Column, entry_name: Column) -> Column:
    """Id of a file's candidate (entry_name NULL: the file itself), so that a replay yields the same candidate."""
    return _name_uuid(F.concat_ws("/", F.lit("candidate"), file_id, entry_name))


def incoming_key(org: Column, batch: Column, file_id: Column, name: Column) -> Column:
    """Key of an uploaded object; an unnamed upload is called upload.bin."""
    base = base_name(F.coalesce(F.nullif(name, F.lit("")), F.lit("upload.bin")))
    return F.concat_ws("/", F.lit("incoming"), org, batch, F.concat_ws("_", file_id, base))


def staging_prefix(org: Column, batch: Column, file_id: Column) -> Column:
    """Prefix of everything staged for one file."""
    return F.concat_ws("/", F.lit("staging"), org, batch, file_id, F.lit(""))


def staging_key(org: Column, batch: Column, file_id: Column, index: Column, name: Column) -> Column:
    """Key of one staged candidate: at least four digits of index, never cut."""
    return F.concat(staging_prefix(org, batch, file_id), F.format_string("%04d_%s", index, name))


def processed_key(org: Column, document: Column, name: Column) -> Column:
    """Key of a library document's first version."""
    return F.concat_ws("/", F.lit("processed"), org, document, F.concat(F.lit("v1_"), name))


def location(bucket: str, key: Column) -> Column:
    """Address of an object."""
    return F.concat(F.lit(f"s3://{bucket}/"), key)
