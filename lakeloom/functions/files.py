"""Facts about files, from their path (or the row of a listing)."""

from __future__ import annotations

from lakeloom.functions.base import Any, Col, F, named, over_columns

__all__ = ["build_stage_file_url", "fl_get_content_type", "fl_get_file_type", "fl_get_relative_path", "fl_is_audio", "fl_is_compressed", "fl_is_document", "fl_is_image", "fl_is_video", "fl_get_size", "fl_get_last_modified", "fl_get_stage", "fl_get_etag", "fl_get_scoped_file_url", "fl_get_stage_file_url", "to_file"]

#: Kinds of files by extension (fixed values).
KINDS = {
    "audio": ["mp3", "wav", "flac", "ogg", "aac", "m4a"], "compressed": ["gz", "zip", "bz2", "zst", "xz", "7z", "tar", "br", "lz4"], "document": ["pdf", "doc", "docx", "odt", "ppt", "pptx", "xls", "xlsx", "txt", "html", "md"],
    "image": ["png", "jpg", "jpeg", "gif", "bmp", "webp", "tiff", "svg"], "video": ["mp4", "mkv", "avi", "mov", "webm", "mpeg"],
}


def _extension(path):
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def _is(kind: str):
    @over_columns
    def check(path):
        return _extension(path).isin(KINDS[kind])

    return check


fl_is_audio, fl_is_compressed, fl_is_document, fl_is_image, fl_is_video = (_is(k) for k in KINDS)


@over_columns
def fl_get_file_type(path):
    """audio, compressed, document, image, video, or unknown."""
    out = F.lit("unknown")
    for kind, extensions in KINDS.items():
        out = F.when(_extension(path).isin(extensions), kind).otherwise(out)
    return out


@over_columns
def fl_get_content_type(path):
    types = {"pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "html": "text/html", "txt": "text/plain", "csv": "text/csv", "json": "application/json", "mp3": "audio/mpeg", "mp4": "video/mp4", "gz": "application/gzip", "zip": "application/zip"}
    out = F.lit("application/octet-stream")
    for extension, kind in types.items():
        out = F.when(_extension(path) == extension, kind).otherwise(out)
    return out


@over_columns
def fl_get_relative_path(path):
    return F.regexp_replace(path, r"^[a-z0-9]+:/+[^/]*/|^@[^/]*/", "")


@over_columns
def fl_get_stage(path):
    return F.regexp_extract(path, r"^(@[^/]*|[a-z0-9]+:/+[^/]*)", 1)


def fl_get_size(row: Any) -> Col:
    return Col(named(row)["length"])


def fl_get_last_modified(row: Any) -> Col:
    return Col(named(row)["modificationTime"])


def build_stage_file_url(stage: str, path: Any) -> Col:
    return Col(F.concat(F.lit(stage.rstrip("/") + "/"), named(path) if not isinstance(path, str) else F.lit(path)))


def fl_get_etag(row: Any) -> Col:
    """A digest of a file's path, length and time, which changes when the file does."""
    row = named(row)
    return Col(F.md5(F.concat_ws("|", row["path"], row["length"].cast("string"), row["modificationTime"].cast("string"))))


def fl_get_stage_file_url(row: Any) -> Col:
    return Col(named(row)["path"])


fl_get_scoped_file_url = fl_get_stage_file_url


def to_file(path: Any) -> Col:
    """A struct of a file's path and what its path says of it."""
    path = named(path)
    return Col(F.struct(path.alias("path"), fl_get_relative_path(path).c.alias("relative_path"), fl_get_content_type(path).c.alias("content_type")))
