"""Column functions: hash ranks, paths, text checks, score formulas, rounding and wording."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Strings that stand for an unknown attribute.
PLACEHOLDERS = ("unknown", "n/a", "na", "none", "")
#: How HTML documents begin.
HTML_MARKS = ("<!doctype html", "<html", "<head", "<body")


# --- hashes -------------------------------------------------------------------------------------------------------
def hash_rank(seed: int, key: str) -> Column:
    """Hex digest to order rows by: the same for any engine, partitioning and row order."""
    return F.sha1(F.concat(F.lit(f"{seed}:"), F.col(key)))


def shard_of(key: Column, n: int) -> Column:
    return F.pmod(F.conv(F.substring(F.sha1(key), 1, 8), 16, 10).cast("long"), F.lit(n)).cast("int")


# --- text and paths -----------------------------------------------------------------------------------------------
def normalise_attr(c: Column) -> Column:
    """Trimmed and in lower case; placeholders are null."""
    text = F.lower(F.trim(c))
    return F.when(~text.isin(*PLACEHOLDERS), text)


def looks_like_html(c: Column) -> Column:
    head = F.lower(F.regexp_replace(F.substring(c, 1, 1024), r"^\s+", ""))
    found = F.lit(False)
    for mark in HTML_MARKS:
        found = found | head.startswith(mark)
    return F.coalesce(found, F.lit(False))


def safe_relpath(c: Column) -> Column:
    """True where joining ``c`` to a folder gives a path inside that folder, on any system; false for null."""
    return F.coalesce((c != "") & ~c.startswith("/") & ~F.array_contains(F.split(c, "/"), "..") & ~c.contains("\\"), F.lit(False))


def stem(c: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"(?<=.)\.[^.]*$", "")


def glob_pattern(glob: str) -> str:
    """A file-name glob as a regular expression; * also crosses folders."""
    out, i = "", 0
    while i < len(glob):
        c, i = glob[i], i + 1
        end = glob.find("]", i + 1) if c == "[" else -1
        if end > 0:
            inner, i = glob[i:end], end + 1
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]"
        else:
            out += {"*": ".*", "?": "."}.get(c) or ("\\" + c if c in ".+^$(){}|\\[]" else c)
    return f"^(?s:{out})$"


def literal_folder(glob: str) -> str:
    """The folder that a glob stays in: its leading parts without wildcards."""
    parts = glob.split("/")
    wild = [i for i, p in enumerate(parts) if set(p) & set("*?[")]
    return "/".join(parts[: wild[0]] if wild else parts[:-1] or parts)


def shortened(name: Column, window) -> Column:  # noqa: ANN001
    """A name without its parenthetical, unless another row of the window has the same."""
    base = F.split(name, r" \(")[0]
    return F.when(F.count("*").over(window) == 1, base).otherwise(name)


def audio_suffix(stored: Column, data: Column) -> Column:
    """Suffix under which an embedded clip is written: a known one of ``stored``, or what ``data`` begins with, or .bin."""
    own = F.regexp_extract(F.lower(stored), r"[^/](\.(?:wav|flac|mp3|ogg|m4a|opus))$", 1)
    out = F.when(own != "", own)
    # fixed values: leading bytes of audio formats
    for head, suffix in ((b"RIFF", ".wav"), (b"fLaC", ".flac"), (b"OggS", ".ogg"), (b"ID3", ".mp3"), (b"\xff\xfb", ".mp3"), (b"\xff\xf3", ".mp3"), (b"\xff\xf2", ".mp3")):
        out = out.when(F.startswith(data, F.lit(head)), suffix)
    return out.otherwise(".bin")


# --- scores -------------------------------------------------------------------------------------------------------
def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def softmax_first(a: Column, b: Column) -> Column:
    """The first of two logits as a probability."""
    top = F.greatest(a, b)
    return F.exp(a - top) / (F.exp(a - top) + F.exp(b - top))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def mean_sigmoid(logits: Column) -> Column:
    return _total(F.transform(logits, sigmoid)) / F.size(logits)


def sigmoid_logsumexp(values: Column) -> Column:
    """sigmoid(log(sum(exp(-x)))) without overflow."""
    low = F.array_min(values)
    return sigmoid(F.log(_total(F.transform(values, lambda x: F.exp(low - x)))) - low)


def rms_db(samples: Column) -> Column:
    """Loudness with a floor at -120."""
    power = _total(F.transform(samples, lambda x: x * x)) / F.size(samples)
    return F.when(power > 0, F.greatest(20 * F.log10(F.sqrt(power)), F.lit(-120.0))).otherwise(F.lit(-120.0))


# --- boxes --------------------------------------------------------------------------------------------------------
def iou(a: Column, b: Column) -> Column:
    """Overlap of two [x1, y1, x2, y2] boxes whose end pixels count."""
    side = lambda lo, hi: F.greatest(hi - lo + 1, F.lit(0.0))
    inter = side(F.greatest(a[0], b[0]), F.least(a[2], b[2])) * side(F.greatest(a[1], b[1]), F.least(a[3], b[3]))
    area = lambda x: (x[2] - x[0] + 1) * (x[3] - x[1] + 1)
    return inter / (area(a) + area(b) - inter)


def track_point(box: Column) -> Column:
    """Centre and half of the larger side."""
    half = F.greatest(box[2] - box[0], box[3] - box[1]) / 2
    return F.array((box[0] + box[2]) / 2, (box[1] + box[3]) / 2, half)


# --- wording ------------------------------------------------------------------------------------------------------
def duration_text(seconds: Column) -> Column:
    """1 h 02 m, 3 m 04 s, or 5 s."""
    s = F.floor(seconds).cast("long")
    h, m, rest = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    return F.when(s >= 3600, F.format_string("%d h %02d m", h, m)).when(s >= 60, F.format_string("%d m %02d s", m, rest)).when(s.isNotNull(), F.format_string("%d s", s))


def auc_bin(auc: Column) -> Column:
    """How far from chance, with its sign: -4 to 4."""
    far = F.abs(2 * auc - 1)
    size = F.when(far < 0.2, 0).when(far < 0.5, 1).when(far < 0.8, 2).when(far < 0.94, 3).otherwise(4)
    return F.when(auc.isNotNull(), F.when(auc < 0.5, -size).otherwise(size))


def first_and_more(values: Column, n: int) -> Column:
    """The first names of a sorted distinct list, and how many more there are."""
    names = F.array_sort(F.array_distinct(values))
    head = F.array_join(F.slice(names, 1, n), ", ")
    return F.when(F.size(names) > n, F.concat(head, F.lit(" and "), (F.size(names) - n).cast("string"), F.lit(" more"))).otherwise(head)
