"""Lines, prompts and mail data blocks of rebuilt text streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.text import each, octets, with_matches
from packetloom.operators.ordered import last_value, lead, running_count, running_sum, scan
from packetloom.session import cut

# Longest marker, rounded up: so much of a stream is seen again by the next window.
TAIL = 16
WINDOW = 65_536
POSITIONS = 1 << 20


def record_pattern(max_chars: int) -> str:
    """One record: a full-length piece, a line with its ending, a control byte alone, or what is left."""
    text = "[^\\x00-\\x1f]"
    return (
        f"{text}{{{max_chars}}}|{text}{{{max_chars - 1}}}\\r|{text}{{0,{max_chars - 1}}}\\n"
        f"|{text}{{0,{max_chars - 2}}}\\r[\\n\\x00]?|[\\x00-\\x09\\x0b\\x0c\\x0e-\\x1f]|{text}{{1,{max_chars - 1}}}"
    )


def prompt_name(data: Column) -> Column:
    """Last word before a trailing colon, lower-cased and cleaned; null when there is no prompt."""
    stripped = F.rtrim(F.regexp_replace(data, "[ \\t]+$", ""))
    word = F.regexp_extract(stripped, "([^\\s]{1,64})\\s*:$", 1)
    whole = F.regexp_extract(stripped, "(\\S+)\\s*:$", 1)
    cleaned = F.regexp_replace(F.lower(word), "[^a-z0-9_-]", "")
    usable = (word == whole) & F.rlike(word, F.lit("^[\\x00-\\x7f]+$"))
    return F.when(usable, F.nullif(cleaned, F.lit("")))


def segment_records(streams: DataFrame, text: str, role: str, max_chars: int = 4096) -> DataFrame:
    """Records of each text with byte offsets that cover it exactly, each labelled by how it ends.

    ``bounded`` pieces reached the length limit, ``line`` ends with a line ending, ``control`` is one control
    byte, ``prompt`` is the rest of a server text ending in a colon, ``text`` is any other rest.
    """
    keys = [c for c in streams.columns if c != text]
    sized = streams.withColumn("__size", octets(F.col(text)))
    found = with_matches(sized, {"__hits": record_pattern(max_chars)}, text)
    rows = found.select(*keys, "__size", F.posexplode_outer("__hits").alias("ordinal", "hit")).where("hit IS NOT NULL")
    value = F.col("hit.value")
    at_end = F.col("hit.offset") + octets(value) == F.col("__size")
    full = F.length(value) >= max_chars
    last = F.substring(value, -1, 1)
    label = (
        F.when((last == "\n") | F.rlike(value, F.lit("\\r\\x00$")), "line")
        .when(full, "bounded")
        .when(last == "\r", "line")
        .when(F.rlike(value, F.lit("^[\\x00-\\x1f]$")), "control")
        .when(at_end & (F.col(role) == "server") & F.rlike(value, F.lit(":[ \\t]*$")), "prompt")
        .otherwise("text")
    )
    return rows.select(
        *keys, "ordinal", F.col("hit.offset").alias("offset"), octets(value).alias("byte_length"), label.alias("label"),
        F.when(label == "prompt", prompt_name(value)).alias("prompt"), value.alias("value"),
    )


DATA_LINE = "(?i)(?:^|\\r\\n)DATA\\r\\n"
DATA_END = "\\r\\n\\.(?=\\r\\n)"


def with_base(chunks: DataFrame, keys: Sequence[str], order: str, text: str) -> DataFrame:
    """Byte position of every chunk in its stream."""
    sized = chunks.withColumn("__octets", octets(F.col(text)).cast("long"))
    return scan(sized, keys, order, {"base": running_sum(F.col("__octets"), inclusive=False)}).drop("__octets")


def stream_windows(chunks: DataFrame, keys: Sequence[str], order: str, text: str, window: int, before: int, after: int) -> DataFrame:
    """Streams (text or bytes) cut anew by byte position, whatever their chunks: keys, ``__window``, its position ``__at`` and ``__raw``.

    A window holds ``window`` bytes and as many beside it as asked for.  One character of ``__raw`` is one byte.
    """
    data = F.col(text) if chunks.schema[text].dataType.simpleString() == "binary" else F.encode(F.col(text), "UTF-8")
    placed = with_base(chunks.select(*keys, order, text), keys, order, text).select(
        *keys, F.col("base").alias("__base"), data.alias("__data"), octets(F.col(text)).cast("long").alias("__octets")
    ).where("__octets > 0")
    first = F.greatest(F.lit(0), F.expr(f"(__base - {after}) div {window}"))
    dealt = placed.select("*", F.explode(F.sequence(first, F.expr(f"(__base + __octets - 1 + {before}) div {window}"))).alias("__window"))
    low = F.greatest("__base", F.col("__window") * window - before)
    high = F.least(F.col("__base") + F.col("__octets"), (F.col("__window") + 1) * window + after)
    part = F.substring("__data", (low - F.col("__base") + 1).cast("int"), (high - low).cast("int"))
    pieces = dealt.where(low < high).select(*keys, "__window", F.struct(low.alias("at"), F.decode(part, "ISO-8859-1").alias("raw")).alias("__piece"))
    return pieces.groupBy(*keys, "__window").agg(F.array_sort(F.collect_list("__piece")).alias("__pieces")).select(
        *keys, "__window", F.col("__pieces")[0]["at"].alias("__at"), F.array_join(F.transform("__pieces", lambda x: x["raw"]), "").alias("__raw")
    )


def extract_data_blocks(chunks: DataFrame, keys: Sequence[str], order: str, text: str, window: int = WINDOW) -> DataFrame:
    """Ranges between a DATA line and the dot line that ends it, in stream positions: start, end, status and ordinal.

    A block that no dot line ends is ``incomplete`` and reaches to the end of its stream; the others are ``complete``.
    Neither chunks nor ``window`` change the result.  A DATA line sets a stream open and a dot line closed.  Where a dot
    follows a DATA line at once, both share a line end: it opens a closed stream and closes an open one.  So the state at
    a marker is that of the last plain marker, turned by each shared one since.
    """
    keys = list(keys)
    windows = stream_windows(chunks, keys, order, text, window, TAIL, 0).select(
        *keys, "__window", "__at", F.regexp_replace("__raw", "[^\\x00-\\x7f]", "?").alias("__text"))
    found = with_matches(windows, {"__opens": DATA_LINE, "__ends": DATA_END}, "__text")
    # The anchor also matches where a later window starts, which is no line start.
    real = F.filter("__opens", lambda m: (F.col("__at") == 0) | (m["offset"] > 0) | F.startswith(m["value"], F.lit("\r\n")))
    opens = F.transform(real, lambda m: F.struct((F.col("__at") + m["offset"] + octets(m["value"]) - 2).alias("at"), F.lit(True).alias("data")))
    ends = F.transform("__ends", lambda m: F.struct((F.col("__at") + m["offset"]).alias("at"), F.lit(False).alias("data")))
    marks = each(found, keys, F.concat(opens, ends), "m").groupBy(*keys, F.col("m.at").alias("at")).agg(
        F.bool_or("m.data").alias("data"), F.bool_or(~F.col("m.data")).alias("dot"))
    # Few and narrow; each scan reads its input twice.
    marks = cut(marks)
    shared = F.col("data") & F.col("dot")
    counted = scan(marks, keys, "at", {"__turns": running_count(shared, inclusive=False)}, span=POSITIONS)
    plain = F.when(~shared, F.struct(F.col("data").alias("open"), F.col("__turns").alias("turns")))
    known = scan(counted, keys, "at", {"__set": last_value(plain)}, span=POSITIONS)
    turned = (F.col("__turns") - F.coalesce("__set.turns", F.lit(0))) % 2 == 1
    is_open = F.coalesce("__set.open", F.lit(False)) != turned
    events = known.select(*keys, "at", (F.col("data") & ~is_open).alias("opens"), (F.col("dot") & is_open).alias("closes")).where("opens OR closes")
    paired = scan(events, keys, "at", {"__close": lead(F.col("at")), "ordinal": running_count(F.col("opens"), inclusive=False)}, span=POSITIONS)
    sizes = chunks.groupBy(*keys).agg(F.sum(octets(F.col(text)).cast("long")).alias("__size"))
    return paired.where("opens").join(sizes, keys).select(
        *keys, (F.col("at") + 2).alias("start"), F.coalesce(F.col("__close") + 2, F.col("__size")).alias("end"),
        F.when(F.col("__close").isNull(), "incomplete").otherwise("complete").alias("status"), "ordinal",
    )


def block_text(blocks: DataFrame, chunks: DataFrame, keys: Sequence[str], order: str, text: str, window: int = WINDOW) -> DataFrame:
    """Bytes of each block with doubled dots at line starts undone, one row (``piece_start``, ``piece``) per window it reaches.

    A line starts with the block and after a line end, by stream position; one byte on either side of a window tells.
    A block is never joined into one value.
    """
    keys = list(keys)
    windows = stream_windows(chunks, keys, order, text, window, 1, 1)
    reached = blocks.where("start < end").select(
        *keys, "ordinal", "start", "end", F.explode(F.sequence(F.expr(f"start div {window}"), F.expr(f"(end - 1) div {window}"))).alias("__window"))
    low, high = F.greatest("start", F.col("__window") * window), F.least("end", (F.col("__window") + 1) * window)
    placed = reached.join(windows, [*keys, "__window"]).select(*keys, "ordinal", "start", "end", "__at", "__raw", low.alias("low"), high.alias("high"))
    left = F.when(F.col("low") > F.col("start"), 1).otherwise(0)
    right = F.when(F.col("high") < F.col("end"), 1).otherwise(0)
    seen = F.substring("__raw", (F.col("low") - left - F.col("__at") + 1).cast("int"), (F.col("high") - F.col("low") + left + right).cast("int"))
    plain = F.regexp_replace(seen, "(?<=[\\r\\n])\\.(?=\\.)", "")
    undone = F.when(left == 0, F.regexp_replace(plain, "\\A\\.(?=\\.)", "")).otherwise(plain)
    own = F.substring(undone, (left + 1).cast("int"), (F.length(undone) - left - right).cast("int"))
    return placed.select(*keys, "ordinal", F.col("low").alias("piece_start"), F.encode(own, "ISO-8859-1").alias("piece"))
