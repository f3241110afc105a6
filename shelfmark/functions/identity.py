"""Identity keys as Column expressions: stable ids, format keys and matching keys."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Namespaces of file and segment ids; ids need only be stable.
FILE_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:shelfmark:file")
SEGMENT_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:shelfmark:segment")

# Formats with more than one extension, and the supported extensions of each modality.
FORMAT_ALIASES = {"aif": "aiff", "jpg": "jpeg", "jfif": "jpeg", "tif": "tiff", "wave": "wav"}
EXTENSIONS = {
    "image": (".bmp", ".dib", ".gif", ".jfif", ".jpeg", ".jpg", ".jpe", ".png", ".tif", ".tiff", ".webp"),
    "audio": (".aif", ".aiff", ".flac", ".m4a", ".mp3", ".oga", ".ogg", ".wav", ".wave"),
    "text": (".pdf", ".htm", ".html", ".md", ".docx", ".pptx"),
}
FORMAT_ORDER = ("docx", "html", "md", "pdf", "pptx")


def uuid5(namespace: uuid.UUID, name: Column) -> Column:
    """Version-5 UUID of ``namespace`` and a string; null for null."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    parts = [F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12)]
    return F.when(name.isNotNull(), F.concat_ws("-", *parts))


def file_id(path_key: Column) -> Column:
    return uuid5(FILE_NAMESPACE, path_key)


def segment_id(path_key: Column, index: Column) -> Column:
    """Id of a segment; a negative index is an error."""
    checked = F.when(index < 0, F.raise_error(F.lit("segment index must not be negative"))).otherwise(index.cast("string"))
    return uuid5(SEGMENT_NAMESPACE, F.concat(path_key, F.lit("\u0000"), checked))


#: Letters whose case folding isn't their lower case, from the database of characters Python carries (about 100 with several letters).
FOLDED = {c: f for c in map(chr, range(0x80, 0x1FFFF)) if (f := c.casefold()) != c.lower() and not 0xD800 <= ord(c) <= 0xDFFF}
_ONE = {c: f for c, f in FOLDED.items() if len(f) == 1}
_MANY = {c: f for c, f in FOLDED.items() if len(f) > 1}


def fold(text: Column) -> Column:
    """Case folding as Python's ``casefold``: lower case, but for the letters that fold otherwise (ß, ligatures, final sigma and the like).

    Plain ASCII takes the short way.
    """
    single = F.translate(text, "".join(_ONE), "".join(_ONE.values()))
    rare = F.regexp_replace(single, f"([{''.join(_MANY)}])", "\u0001$1\u0002")
    split = F.transform(F.split(rare, "\u0001"), lambda part: F.coalesce(F.concat(F.try_element_at(_table(), F.substring_index(part, "\u0002", 1)), F.substring_index(part, "\u0002", -1)), part))
    special = F.when(F.contains(rare, F.lit("\u0002")), F.array_join(split, "")).otherwise(single)
    return F.when(text.rlike(r"^\p{ASCII}*$"), F.lower(text)).otherwise(F.lower(special))


def _table() -> Column:
    return F.create_map(*[F.lit(x) for pair in _MANY.items() for x in pair])


def format_key(extension: Column) -> Column:
    """Trimmed, one leading dot off, case-folded, aliases resolved."""
    bare = F.regexp_replace(fold(F.trim(extension)), r"^\.", "")
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in FORMAT_ALIASES.items() for x in p]), bare), bare)


def file_type_of(extension: Column, extensions: Mapping[str, Iterable[str]] = EXTENSIONS) -> Column:
    """image, audio or text by extension (any letter case); null for others."""
    low = fold(extension)
    out = F.lit(None).cast("string")
    for kind, known in extensions.items():
        out = F.when(low.isin(*known), F.lit(kind)).otherwise(out)
    return out


def extension_of(name: Column) -> Column:
    """Last suffix of a file name with its dot; '' for none; a leading dot alone is no suffix."""
    return F.regexp_extract(name, r"[^/\\](\.[^./\\]+)$", 1)


def file_name_key(name: Column) -> Column:
    """Base name, either slash, case-folded."""
    return fold(F.element_at(F.split(F.translate(F.trim(name), "\\", "/"), "/"), -1))


def identity_key(text: Column) -> Column:
    """Case-folded letters and numbers only."""
    return F.regexp_replace(fold(text), r"[^\p{L}\p{N}]", "")


def query_key(text: Column) -> Column:
    """White space collapsed and case folded."""
    return fold(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def file_key(name: Column) -> Column:
    """Letters and numbers of a file's stem: the base name without its last suffix."""
    base = F.element_at(F.split(F.translate(F.trim(name), "\\", "/"), "/"), -1)
    return identity_key(F.regexp_replace(base, r"(?<=.)\.[^.]+$", ""))


def query_type_of(text: Column, official: Sequence[str]) -> Column:
    """The official type of the same letters and numbers, else Other; a blank one is an error."""
    known = F.create_map(*[F.lit(x) for k in official for x in ("".join(c for c in k.casefold() if c.isalnum()), k)])
    kind = F.coalesce(F.try_element_at(known, identity_key(text)), F.lit("Other"))
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", F.raise_error(F.lit("a query type is blank"))).otherwise(kind)


def query_id(identity: Column, query: Column) -> Column:
    """Id of a question of one enterprise: both keys with a colon between them."""
    return F.concat(identity_key(identity), F.lit(":"), query_key(query))


def logical_document_id(path: Column) -> Column:
    """Grandparent folder and stem: the same document in another format has the same id."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    grandparent = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 2, F.lit(0))), "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]+$", "")
    return F.concat(fold(grandparent), F.lit("/"), identity_key(stem))


def enterprise_of(path: Column) -> Column:
    """Name of the grandparent folder."""
    return F.try_element_at(F.split(F.translate(path, "\\", "/"), "/"), F.lit(-3))


def format_position(fmt: Column) -> Column:
    """Position in the order of document formats; unknown ones come last."""
    at = F.array_position(F.array(*[F.lit(f) for f in FORMAT_ORDER]), fmt)
    return F.when(at > 0, at).otherwise(F.lit(len(FORMAT_ORDER) + 1))
