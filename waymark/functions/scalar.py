"""Scalar column functions: text, keys, hashes, display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.functions.binding import let

BLANK = r"(?U)^\s+|\s+$"


def strip(x: Column) -> Column:
    """Without white space at the ends (``trim`` strips spaces only)."""
    return F.regexp_replace(x, BLANK, "")


def blank_to_null(x: Column) -> Column:
    """The stripped text, or null where nothing is left."""
    return F.nullif(strip(x), F.lit(""))


def collapse(x: Column) -> Column:
    """Stripped, with every run of white space as one space; case stays."""
    return F.regexp_replace(strip(x), r"(?U)\s+", " ")


def collapse_folded(x: Column) -> Column:
    return F.lower(collapse(x))


def normalize_task_id(x: Column, anywhere: bool = False) -> Column:
    """Stripped and lower-cased, without the markers of revised tasks.

    The markers ``.improved.`` and ``.resized.`` stand between two parts;
    ``anywhere`` removes ``.improved`` and then ``.resized`` wherever they stand.
    """
    low = F.lower(strip(x))
    if anywhere:
        return F.replace(F.replace(low, F.lit(".improved"), F.lit("")), F.lit(".resized"), F.lit(""))
    return F.replace(F.replace(low, F.lit(".improved."), F.lit(".")), F.lit(".resized."), F.lit("."))


def composite_key(*parts: Column, delimiter: str = "::") -> Column:
    """Parts joined by a reserved delimiter; an error where a part holds it."""
    clash = F.lit(False)
    for p in parts:
        clash = clash | F.contains(p, F.lit(delimiter))
    return F.when(clash, F.raise_error(F.lit(f"key part holds {delimiter}")).cast("string")).otherwise(F.concat_ws(delimiter, *parts))


def key_part(key: Column, index: int, delimiter: str = "::") -> Column:
    return F.get(F.split(key, delimiter), F.lit(index))


def stable_rank(seed: int, namespace: str, *values: Column) -> Column:
    """16 hex digits of a digest: orders like the unsigned 64-bit number they write."""
    return F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.lit(namespace), *values), 256), 1, 16)


def hash_bucket(rank: Column, n: int) -> Column:
    """0 .. n-1 from the first 15 hex digits of a rank."""
    return F.pmod(F.conv(F.substring(rank, 1, 15), 16, 10).cast("long"), F.lit(n)).cast("int")


def row_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def termination_signal(action: Column, names: tuple[str, ...]) -> Column:
    """The call name of an action, where it is one of ``names``; else null."""
    head = F.regexp_extract(strip(action), r"^([A-Za-z_]\w*)\s*\(", 1)
    return F.when(head.isin(*names), head)


def occurrences(text: Column, literal: Column) -> Column:
    """How often a literal that is not empty occurs, without overlaps."""
    gone = F.char_length(text) - F.char_length(F.replace(text, literal, F.lit("")))
    return F.round(gone / F.char_length(literal)).cast("long")


def redacted(x: Column) -> Column:
    """Length and the start of a digest in place of a text; ``None`` for null."""
    shown = F.concat(F.lit("<string:length="), F.char_length(x).cast("string"), F.lit(":sha256="), F.substring(F.sha2(x, 256), 1, 12), F.lit(">"))
    return F.when(x.isNull(), F.lit("None")).otherwise(shown)


def redacted_node(kind: Column, value: Column, size: Column) -> Column:
    """The example of a JSON node: texts as digests, lists and objects by size, other scalars by value."""
    sized = F.when(kind == "list", F.format_string("<list:length=%d>", size)).when(kind == "dict", F.format_string("<object:keys=%d>", size))
    return F.when(kind == "str", redacted(value)).when(kind.isin("list", "dict"), sized).otherwise(F.substring(value, 1, 80))


def safe_path(path: Column, prefix: str, suffix: str, banned: tuple[str, ...] = ("..", "")) -> Column:
    """Starts and ends as asked and has no banned part between slashes."""
    parts = F.split(path, "/")
    return path.startswith(prefix) & path.endswith(suffix) & ~F.exists(parts, lambda p: p.isin(*banned))


def fixed(x: Column, digits: int = 3) -> Column:
    """A fixed number of decimals, half up, on the decimal value; ``NA`` for null."""
    return F.coalesce(F.round(x.cast("decimal(38,12)"), digits).cast(f"decimal(38,{digits})").cast("string"), F.lit("NA"))


def significant(x: Column, digits: int = 3) -> Column:
    """Rounded half up to a number of significant digits."""
    power = F.floor(F.log10(F.abs(x))).cast("int")
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - power)
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x * scale) / scale)


def mebibytes(x: Column) -> Column:
    return fixed(x / (1024 * 1024), 1)


def csv_cell(x: Column, kind: str) -> Column:
    """A value as a CSV cell: empty for null, lower-case booleans."""
    text = F.lower(x.cast("string")) if kind == "boolean" else x.cast("string")
    return F.coalesce(text, F.lit(""))


def interval_bounds(x: Column) -> Column:
    """The two numbers of ``95% CI [a, b]`` as struct<low, high>."""
    pattern = r"95% CI \[\s*([-+0-9.eE]+)\s*,\s*([-+0-9.eE]+)\s*\]"
    low, high = (F.nullif(F.regexp_extract(x, pattern, i), F.lit("")).cast("double") for i in (1, 2))
    return F.struct(low.alias("low"), high.alias("high"))


def has_number(x: Column) -> Column:
    """Whether a text holds a decimal digit of any script."""
    return x.rlike(r"(?U)\d")


def bibtex_keys(x: Column) -> Column:
    """The keys of a bibliography's entries, in order; an entry is ``@kind{key, ...``."""
    return F.regexp_extract_all(x, F.lit(r"(?U)@\w+\s*\{\s*([^,\s]+)"), F.lit(1))


def first_match(path: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The class of the first rule (regular expression, class) that a path matches, in the given order."""
    out = F.lit(default)
    for pattern, name in reversed(rules):
        out = F.when(path.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def chunks(tokens: Column, size: int) -> Column:
    """Non-overlapping windows of at most ``size`` items."""

    def cut(t: Column) -> Column:
        starts = F.sequence(F.lit(0), F.ceil(F.size(t) / size).cast("int") - 1)
        return F.transform(starts, lambda i: F.slice(t, i * size + 1, size))

    return F.when(F.size(tokens) == 0, F.slice(F.array(tokens), 1, 0)).otherwise(let(tokens, cut))
