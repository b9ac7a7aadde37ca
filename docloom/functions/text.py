"""Scalar functions over text and bytes: HTML, dates, formats, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hex of the first bytes -> format, in the order they are tried, between ZIP files and HTML
#: before them and WebP after them (fixed values).
SIGNATURES = [
    ("FFD8FF", "image"), ("89504E470D0A1A0A", "image"), ("474946383761", "image"), ("474946383961", "image"),
    ("49492A00", "image"), ("4D4D002A", "image"), ("424D", "image"),
]
LATE_SIGNATURES = [("7B5C727466", "word"), ("D0CF11E0A1B11AE1", "excel")]
#: Names within a ZIP file's first 2048 bytes -> format, in order; other ZIP files count as excel (fixed values).
OFFICE = [("xl/|worksheets/|sharedStrings", "excel"), ("ppt/|slides/|presentation", "powerpoint"), ("word/|document\\.xml", "word")]
#: MIME types (fixed values).
MIME = {
    "application/pdf": "pdf", "text/html": "html", "application/xhtml+xml": "html",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "excel", "application/vnd.ms-excel": "excel",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "powerpoint", "application/vnd.ms-powerpoint": "powerpoint",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "word", "application/msword": "word",
    "image/png": "image", "image/jpeg": "image", "image/gif": "image", "image/bmp": "image", "image/tiff": "image", "image/webp": "image",
}
EXTENSIONS = {
    "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp",
    "tif": "image/tiff", "tiff": "image/tiff", "webp": "image/webp", "html": "text/html", "htm": "text/html",
}
HTML_MARK = r"<!doctype html|<html|<head>|<body>|<title>|<meta|<div|<p>|<h1>|<script"


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def mime_of_name(path: Column) -> Column:
    return lookup(EXTENSIONS, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))


def is_html(content: Column) -> Column:
    """An HTML mark among the first 1000 bytes."""
    return F.lower(F.decode(F.substring(content, 1, 1000), "ISO-8859-1")).rlike(HTML_MARK)


def format_by_signature(content: Column) -> Column:
    """Format by the first bytes; null if unknown."""
    head = F.hex(F.substring(content, 1, 16))
    start = F.decode(F.substring(content, 1, 2048), "ISO-8859-1")
    office = F.lit("excel")
    for names, form in reversed(OFFICE):
        office = F.when(start.rlike(names), form).otherwise(office)
    out = F.when(head.startswith("25504446"), "pdf").when(head.startswith("504B"), office)
    out = out.when(start.startswith("<!DOCTYPE html") | start.startswith("<html") | start.startswith("<HTML"), "html")
    for magic, form in SIGNATURES:
        out = out.when(head.startswith(magic), form)
    out = out.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image")
    for magic, form in LATE_SIGNATURES:
        out = out.when(head.startswith(magic), form)
    return out


def detect_format(content: Column, mime: Column) -> Column:
    """Format by MIME type, else by signature."""
    return F.coalesce(lookup(MIME, F.lower(mime)), format_by_signature(content))


def is_valid(content: Column, form: Column) -> Column:
    """Does the content hold what the format asks for? PDFs must not be encrypted."""
    text = F.decode(content, "ISO-8859-1")
    found = format_by_signature(content)
    return F.when(form == "pdf", (found == "pdf") & ~text.contains("/Encrypt")).when(form == "html", is_html(content)).otherwise(F.coalesce(found == form, F.lit(False)))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def stamp(c: Column, form: str) -> Column:
    return F.try_to_timestamp(c, F.lit(form))


def pdf_date(c: Column) -> Column:
    """``D:YYYYMMDDHHMMSS...`` as ISO; null if short or not a date."""
    digits = F.substring(F.regexp_replace(c, "^D:", ""), 1, 14)
    return F.when(digits.rlike(r"^\d{14}$"), iso(stamp(digits, "yyyyMMddHHmmss")))


def exif_date(c: Column) -> Column:
    ok = (F.char_length(c) == 19) & (F.substring(c, 5, 1) == ":") & (F.substring(c, 8, 1) == ":")
    return F.when(ok, iso(stamp(c, "yyyy:MM:dd HH:mm:ss")))


def html_date(c: Column) -> Column:
    """Six formats in order, month before day where both fit."""
    day = r"\d{4}-\d{1,2}-\d{1,2}"
    time = r"\d{1,2}:\d{1,2}:\d{1,2}"
    forms = [
        (f"^{day}$", "yyyy-M-d"),
        (f"^{day}T{time}$", "yyyy-M-d'T'H:m:s"),
        (f"^{day}T{time}Z$", "yyyy-M-d'T'H:m:s'Z'"),
        (f"^{day} {time}$", "yyyy-M-d H:m:s"),
        (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
        (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    ]
    return F.coalesce(*[F.when(c.rlike(p), iso(stamp(c, f))) for p, f in forms])


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def html_title(html: Column) -> Column:
    found = F.regexp_extract(html, r"(?i)<title[^>]*>([^<]*)</title>", 1)
    return F.when(html.rlike(r"(?i)<title[^>]*>[^<]*</title>"), F.substring(stripped(found), 1, 200))


def html_meta(html: Column, attributes: list[str], most: int | None = None) -> Column:
    """Content of the first meta tag with one of the attributes (such as ``name="author"``) that isn't empty."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)(<meta[^>]+>)"), F.lit(1))
    has = lambda t: F.exists(F.array(*map(F.lit, attributes)), lambda a: F.lower(t).contains(a))
    texts = F.transform(F.filter(tags, has), lambda t: stripped(F.regexp_extract(t, r"(?i)content=[\"']([^\"']*)[\"']", 1)))
    first = F.get(F.filter(texts, lambda v: v != ""), F.lit(0))
    return first if most is None else F.substring(first, 1, most)


def html_author(html: Column) -> Column:
    return html_meta(html, ['name="author"', 'property="author"'], 100)


def html_created(html: Column) -> Column:
    return html_date(html_meta(html, ['name="date"', 'name="created"', 'property="article:published_time"']))


def html_pages(html: Column) -> Column:
    """Estimated pages: text length L over 5000 gives L div 3000, else 1."""
    n = F.char_length(stripped(F.regexp_replace(html, "<[^>]*>", "")))
    return F.when(n > 5000, F.greatest(F.lit(1), F.floor(n / 3000))).otherwise(1).cast("int")


def html_dimensions(html: Column) -> Column:
    """Viewport width, with 800 high; 1200 x 800 without one."""
    content = F.regexp_extract(html, r"(?i)<meta[^>]*name=[\"']viewport[\"'][^>]*content=[\"']([^\"']*)[\"']", 1)
    width = F.regexp_extract(content, r"width=(\d+)", 1)
    return F.struct(F.coalesce(F.when(width != "", width.cast("double")), F.lit(1200.0)).alias("width"), F.lit(800.0).alias("height"))


def html_text(html: Column) -> Column:
    """Text of HTML: scripts and styles go, breaks become lines, tags go, blanks collapse. Entities stay."""
    t = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", "")
    t = F.regexp_replace(t, r"(?is)<style[^>]*>.*?</style>", "")
    t = F.regexp_replace(t, r"(?i)<br[^>]*>", "\n")
    t = F.regexp_replace(t, r"(?i)<p[^>]*>", "\n\n")
    t = F.regexp_replace(t, r"(?i)<h[1-6][^>]*>", "\n\n")
    t = F.regexp_replace(t, r"(?i)<div[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", "")
    t = F.regexp_replace(t, r"\n\s*\n", "\n\n")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def pascal_case(c: Column) -> Column:
    return F.replace(F.initcap(F.translate(c, "-_", "  ")), F.lit(" "), F.lit(""))


def good_name(c: Column) -> Column:
    return c.rlike("^[a-zA-Z][a-zA-Z0-9_]*$") & ~F.lower(c).isin("class", "function", "import", "client", "prompt")


def draft_number(url: Column) -> Column:
    return F.regexp_extract(url, r"draft-(\d+)", 1).try_cast("int")


def coerced(raw: Column, success: Column) -> Column:
    """A model's answer as a variant: JSON as it is, other text as {extracted_text}, a failure as {}."""
    text = F.to_variant_object(F.struct(raw.alias("extracted_text")))
    return F.when(~success, F.parse_json(F.lit("{}"))).otherwise(F.coalesce(F.when(raw.rlike(r"^\s*\{"), F.try_parse_json(raw)), text))


def cleaned(c: Column) -> Column:
    """A value as it is kept after a failed validation: trimmed text, null as an empty text."""
    return F.coalesce(F.regexp_replace(c.cast("string"), r"^\s+|\s+$", ""), F.lit(""))


def fitted(width: Column, height: Column, box_w: int, box_h: int) -> Column:
    """Size of an image scaled to fit a box, and the margins that centre it."""
    aspect = width / height
    wide = aspect > box_w / box_h
    w = F.when(wide, box_w).otherwise(F.floor(box_h * aspect)).cast("int")
    h = F.when(wide, F.floor(box_w / aspect)).otherwise(box_h).cast("int")
    return F.struct(w.alias("width"), h.alias("height"), F.floor((box_w - w) / 2).cast("int").alias("left"), F.floor((box_h - h) / 2).cast("int").alias("top"))


def page_batch(dpi: Column, pages: Column, memory_mb: float) -> Column:
    """Pages (A4, three bytes a pixel) that fit the memory at once, at most all of them."""
    mb = (8.27 * dpi) * (11.69 * dpi) * 3 / (1024 * 1024)
    return F.least(F.greatest(F.lit(1), F.floor(memory_mb / mb)), pages).cast("int")


def model_batch(model_mb: Column, memory_mb: Column) -> Column:
    """Images of 100 MB that fit beside a model, with a third in reserve; 1 to 16."""
    return F.least(F.lit(16), F.greatest(F.lit(1), F.floor((memory_mb - model_mb * 2.5) * 0.7 / 100))).cast("int")


def pdf_metadata(content: Column) -> Column:
    """What a PDF says of itself in plain objects: pages, first page's box, title, author, creation date.

    Objects in compressed streams need a parser, which is plugged in as an adapter.
    """
    t = F.decode(content, "ISO-8859-1")
    get = lambda p: F.when(t.rlike(p), F.regexp_extract(t, p, 1))
    box = r"/MediaBox\s*\[\s*-?[\d.]+\s+-?[\d.]+\s+([\d.]+)\s+([\d.]+)\s*\]"
    return F.struct(
        F.regexp_count(t, F.lit(r"/Type\s*/Page[^s]")).alias("page_count"),
        F.when(t.rlike(box), F.struct(F.regexp_extract(t, box, 1).cast("double").alias("width"), F.regexp_extract(t, box, 2).cast("double").alias("height"))).alias("dimensions"),
        get(r"/Title\s*\(([^)]*)\)").alias("title"),
        get(r"/Author\s*\(([^)]*)\)").alias("author"),
        pdf_date(get(r"/CreationDate\s*\(([^)]*)\)")).alias("creation_date"),
    )


def _number(content: Column, at: int, size: int, little: bool) -> Column:
    parts = [F.hex(F.substring(content, at + k, 1)) for k in range(size)]
    return F.conv(F.concat(*(reversed(parts) if little else parts)), 16, 10).cast("int")


def image_dimensions(content: Column) -> Column:
    """Width and height from the header of a PNG, GIF or BMP; null for others."""
    head = F.hex(F.substring(content, 1, 8))
    size = lambda w, h: F.struct(w.alias("width"), h.alias("height"))
    return (
        F.when(head.startswith("89504E47"), size(_number(content, 17, 4, False), _number(content, 21, 4, False)))
        .when(head.startswith("47494638"), size(_number(content, 7, 2, True), _number(content, 9, 2, True)))
        .when(head.startswith("424D"), size(_number(content, 19, 4, True), _number(content, 23, 4, True)))
    )
