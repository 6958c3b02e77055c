"""Names of files and folders as columns: folding, extensions, categories, bands, times, shares."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters whose upper case has more than one character; they fold to themselves.
EXPANDING = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000 and len(chr(i).upper()) > 1)

#: Extensions of each category of files, in the order categories are listed.
CATEGORIES = {
    "images": "jpg jpeg png gif bmp tif tiff webp heic heif avif svg ico psd raw cr2 cr3 nef arw dng orf rw2 raf pef srw",
    "videos": "mp4 mkv avi mov wmv m4v mpg mpeg webm flv 3gp mts m2ts ts vob",
    "audio": "mp3 flac wav aac m4a ogg opus wma aiff alac mid midi",
    "documents": "pdf doc docx xls xlsx ppt pptx odt ods odp rtf txt md csv epub pages numbers key one msg eml",
    "archives": "zip rar 7z tar gz tgz bz2 xz zst cab lz lzma",
    "disk_images": "iso img vhd vhdx vmdk vdi qcow2 wim esd dmg",
    "code": "rs c h cpp hpp cs java kt py js mjs tsx jsx go rb php swift html css scss json xml yaml yml toml sql sh ps1 bat svelte vue",
    "programs": "exe dll msi msix appx sys com scr jar apk",
    "other": "",
}
#: Lower bounds of the size bands in bytes.
BANDS = [0, 1_000, 100_000, 1_000_000, 100_000_000, 1_000_000_000]
#: Extensions of pictures, of camera raw files and of videos that get a print.
IMAGE_EXTENSIONS = "jpg jpeg jpe jfif png gif webp bmp dib tif tiff".split()
RAW_EXTENSIONS = "cr2 cr3 crw nef nrw arw srf sr2 dng orf rw2 raf pef srw 3fr iiq rwl erf kdc mrw x3f".split()
VIDEO_EXTENSIONS = "mp4 m4v mov mkv webm avi wmv asf mpg mpeg m2ts mts 3gp 3g2".split()
MAX_IMAGE_BYTES = 512 * 1024 * 1024
#: Fixed: 100 ns steps from 1601 to 1970.
EPOCH_FILETIME = 116_444_736_000_000_000


def fold(c: Column) -> Column:
    """Upper case, character by character; what would expand stays."""
    each = F.array_join(F.transform(F.split(c, ""), lambda x: F.when(F.length(F.upper(x)) == F.length(x), F.upper(x)).otherwise(x)), "")
    return F.when(c.rlike(f"[{EXPANDING}]"), each).otherwise(F.upper(c))


def fold_text(s: str) -> str:
    return "".join(u if len(u := ch.upper()) == 1 else ch for ch in s)


def equal_names(a: Column, b: Column) -> Column:
    return fold(a) == fold(b)


#: Fixed: the mark before four hex digits that stand for a code unit which is no character.
ESCAPE = "￿"


def decode_name(c: Column) -> Column:
    """Stored name to a readable one: an escaped mark becomes the mark, an unpaired code unit U+FFFD."""
    return F.regexp_replace(F.regexp_replace(c, f"{ESCAPE}[dD][89a-fA-F][0-9a-fA-F]{{2}}", "�"), f"{ESCAPE}[fF]{{4}}", ESCAPE)


def encode_name(c: Column) -> Column:
    """Readable name to a stored one: the mark itself is escaped."""
    return F.replace(c, F.lit(ESCAPE), F.lit(ESCAPE + "FFFF"))


def extension(name: Column) -> Column:
    """Lower case, without the dot; '' without one, for a leading dot only, with a blank, or beyond 16 bytes."""
    e = F.regexp_extract(name, r"(?s)^.+\.([^. ]+)$", 1)
    return F.when(F.octet_length(e) <= 16, F.lower(e)).otherwise(F.lit(""))


def category(ext: Column) -> Column:
    out = F.lit("other")
    for name, exts in reversed(CATEGORIES.items()):
        if exts:
            out = F.when(ext.isin(exts.split()), name).otherwise(out)
    return out


def kind_of(is_dir: Column, name: Column) -> Column:
    return F.when(is_dir, "dir").otherwise(category(extension(name)))


def band(size: Column) -> Column:
    """Number of the size band, from 0."""
    out = F.lit(0)
    for i, low in enumerate(BANDS[1:], 1):
        out = F.when(size >= low, i).otherwise(out)
    return out.cast("long")


def unix_ms(filetime: Column) -> Column:
    """Milliseconds since 1970, rounded down."""
    since = filetime - EPOCH_FILETIME
    return ((since - F.pmod(since, F.lit(10_000))) / 10_000).cast("long")


def filetime(unix_ms: Column) -> Column:
    return unix_ms * 10_000 + EPOCH_FILETIME


def match_score(folded: Column, term: str) -> Column:
    """0 the whole name, 1 its beginning, 2 the beginning of a word in it, 3 elsewhere; `term` is folded."""
    word = f"[ _\\-.(\\[]{re.escape(term)}"
    return F.when(folded == term, 0).when(folded.startswith(term), 1).when(folded.rlike(word), 2).otherwise(3)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("long")


def mean_distance(a: Column, b: Column) -> Column:
    """Mean Hamming distance of frames side by side; null for different numbers of frames or none."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), total / F.size(a))


def normal_unc(c: Column) -> Column:
    """A share's path for comparison: backslashes, no device prefix, no blanks or separators around, folded."""
    s = F.regexp_replace(F.trim(c), "/", "\\\\")
    s = F.regexp_replace(s, r"^\\\\\?\\(?i:UNC)\\", "\\\\\\\\")
    return fold(F.regexp_replace(s, r"\\+$", ""))


def unc_server(c: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(normal_unc(c), r"^\\+", ""), r"\\"), 1)


def unc_share(c: Column) -> Column:
    parts = F.split(F.regexp_replace(normal_unc(c), r"^\\+", ""), r"\\")
    return F.when(F.size(parts) > 1, F.element_at(parts, 2))


def relative_under(path: Column, root: str) -> Column:
    """What of `path` comes after the folder `root` (any case, either separator); null if it isn't below it."""
    r = fold_text(root.replace("/", "\\").rstrip("\\"))
    p = F.regexp_replace(path, "/", "\\\\")
    rest = F.substring(p, len(r) + 1, 1 << 30)
    below = (fold(F.substring(p, 1, len(r))) == r) & ((F.length(rest) == 0) | rest.startswith("\\"))
    return F.when(below, F.regexp_replace(rest, r"^\\+|\\+$", ""))


def is_printable(name: Column) -> Column:
    return extension(name).isin(IMAGE_EXTENSIONS + RAW_EXTENSIONS)


def is_video(name: Column) -> Column:
    """A video by its extension; declaration files that end in .d.mts never are."""
    return extension(name).isin(VIDEO_EXTENSIONS) & ~F.lower(name).endswith(".d.mts")


def local_content(attrs: Column) -> Column:
    """Whether the content is on the disk: none of the bits of placeholders in a cloud."""
    return F.coalesce(attrs, F.lit(0)).bitwiseAND(4_460_544) == 0


def human_bytes(size: Column) -> Column:
    """Decimal units with one digit after the point below a hundred."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for unit, scale in (("KB", 10**3), ("MB", 10**6), ("GB", 10**9), ("TB", 10**12)):
        tenths = F.floor(size / F.lit(scale // 10)).cast("long")
        text = F.when(tenths < 1000, F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))).otherwise(F.floor(tenths / 10).cast("string"))
        out = F.when(size >= scale, F.concat(text, F.lit(f" {unit}"))).otherwise(out)
    return out
