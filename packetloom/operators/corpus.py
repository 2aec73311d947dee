"""Scans of text corpora for secrets, tokens and encoded names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.text import each, explode_matches, octets, with_matches
from packetloom.operators.decode import HEX

# Prefixes and patterns of known secret formats.
KNOWN_PREFIXES = ["flag", "ctf", "key", "answer"]
CSS_DECLARATION = (
    "(?i)(?:^|;)(?:background(?:-position)?|color|display|font-size|line-height|position|text-align|"
    "text-anchor|word-break|word-wrap)\\s*:"
)
# Words before a brace that open a code block.
CODE_WORDS = ["catch", "class", "do", "else", "finally", "for", "foreach", "function", "if", "switch", "try", "while"]
# Sets are spelled out, since the regex engine looks single characters up in a table and compares ranges one by one.  What
# follows a repeated set is never in it, so a repetition need not give back what it took.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
ALNUM = LETTERS + "0123456789"
BRACE = f"(?<![{ALNUM}_])[{LETTERS}][{ALNUM}_-]{{1,32}}+\\{{[\\x21-\\x7a\\x7c\\x7e]{{4,256}}+\\}}(?![{ALNUM}_])"
TOKEN = f"(?<![{ALNUM}_.+/=:-])[{ALNUM}][{ALNUM}_.+/=:-]{{23,127}}+(?![{ALNUM}_.+/=:-])"

CHUNK = 1 << 20
OVERLAP = 512


def known_pattern(prefixes: Sequence[str] = tuple(KNOWN_PREFIXES)) -> str:
    words = "|".join(prefixes)
    # The look-ahead tells most positions apart by one character.
    initials = "".join(sorted({letter for word in prefixes for letter in (word[0].lower(), word[0].upper())}))
    return (
        f"(?=[{{{initials}])(?i:(?<![A-Za-z0-9_])(?:{words})\\{{[^{{}}\\r\\n]{{1,256}}\\}}"
        f"|\\{{(?:{words})[:=][^{{}}\\r\\n]{{1,256}}\\}}"
        f"|(?<![A-Za-z0-9_])(?:{words})[:=][A-Za-z0-9][A-Za-z0-9_.+/-]{{7,255}}(?![A-Za-z0-9_.+/-]))"
    )


def chunk_rows(df: DataFrame, value: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Long values as overlapping pieces ``(piece, piece_base, own_from, own_to)``, short ones as one piece.

    A hit belongs to the piece that owns its first byte, so each is found once.  The overlap on both sides
    is longer than any match, so a match over a border and its surroundings are seen whole.
    """
    length = F.length(F.col(value))
    count = F.greatest(F.ceil(length / F.lit(chunk)), F.lit(1)).cast("int")
    pieces = df.select("*", F.explode(F.sequence(F.lit(0), count - 1)).alias("__n"))
    low = F.greatest(F.col("__n") * chunk - overlap, F.lit(0))
    cut = pieces.select(
        "*", F.substring(F.col(value), low + 1, F.lit(chunk + 2 * overlap)).alias("piece"), low.alias("__low")
    )
    # Byte positions of the piece and of the part it owns.
    base = F.when(F.col("__low") == 0, F.lit(0)).otherwise(octets(F.substring(F.col(value), F.lit(1), F.col("__low"))))
    own_from = F.when(F.col("__n") == 0, F.lit(0)).otherwise(
        octets(F.substring(F.col("piece"), F.lit(1), F.col("__n") * chunk - F.col("__low")))
    )
    own_to = octets(F.substring(F.col("piece"), F.lit(1), (F.col("__n") + 1) * chunk - F.col("__low")))
    return cut.select(
        *[c for c in df.columns if c != value], "piece", base.alias("piece_base"), own_from.alias("own_from"), own_to.alias("own_to")
    )


def _hits(df: DataFrame, value: str, pattern: str, chunk: int) -> DataFrame:
    keys = [c for c in df.columns if c != value]
    found = explode_matches(chunk_rows(df, value, chunk), pattern, "piece")
    return found.where("hit.offset >= own_from AND hit.offset < own_to").select(
        *keys, (F.col("piece_base") + F.col("hit.offset")).alias("offset"), F.col("hit.value").alias("value")
    )


def scan_known(df: DataFrame, value: str, prefixes: Sequence[str] = tuple(KNOWN_PREFIXES), chunk: int = CHUNK) -> DataFrame:
    """Secrets in known formats with byte offset; style declarations and plain words are rejected."""
    hits = _hits(df, value, known_pattern(prefixes), chunk)
    token = F.regexp_replace("value", "^[^:=]*[:=]", "")
    inner = F.regexp_replace(F.regexp_replace("value", "^[^{]*\\{", ""), "\\}$", "")
    plausible = (
        F.when(F.startswith(F.col("value"), F.lit("{")), True)
        .when(~F.contains(F.col("value"), F.lit("{")), F.rlike(token, F.lit("[A-Za-z]")) & F.rlike(token, F.lit("[0-9]")))
        .otherwise(~F.rlike(inner, F.lit(CSS_DECLARATION)))
    )
    prefix = F.lower(F.regexp_extract("value", "(?i)^\\{?(" + "|".join(prefixes) + ")(?:\\{|[:=])", 1))
    return hits.where(plausible).withColumn("prefix", prefix)


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def scan_unknown(df: DataFrame, value: str, chunk: int = CHUNK) -> DataFrame:
    """Flag-like braces with an unknown word, and long mixed tokens."""
    keys = [c for c in df.columns if c != value]
    found = with_matches(chunk_rows(df, value, chunk), {"brace": BRACE, "token": TOKEN}, "piece", {"brace": "{"})

    def labelled(kind: str, hits: str) -> Column:
        return F.transform(
            hits, lambda hit: F.struct(F.lit(kind).alias("kind"), hit["offset"].alias("offset"), hit["value"].alias("value"))
        )

    both = F.concat(labelled("unknown-brace", "brace"), labelled("unknown-token", "token"))
    hits = each(found, [*keys, "piece_base", "own_from", "own_to"], both, "hit")
    owned = hits.where("hit.offset >= own_from AND hit.offset < own_to").select(
        *keys, F.col("hit.kind").alias("kind"), (F.col("piece_base") + F.col("hit.offset")).alias("offset"), F.col("hit.value").alias("value")
    )
    text = F.col("value")
    word = F.lower(F.substring_index(text, "{", 1))
    lower = F.lower(text)
    token = (
        F.length(text).between(24, 128)
        & ~F.rlike(lower, F.lit("^(?:https?://|www\\.)"))
        & (_count(text, "/") <= 3)
        & (_count(text, ".") <= 3)
        & ~F.contains(F.substring(text, F.lit(1), F.length(text) - 2), F.lit("="))
        & F.rlike(text, F.lit("[a-z]"))
        & F.rlike(text, F.lit("[A-Z]"))
        & F.rlike(text, F.lit("[0-9]"))
        & F.rlike(text, F.lit("[_./+=-]"))
        & ~F.rlike(text, F.lit("^[A-Za-z0-9+/=]*$"))
    )
    brace = ~word.isin([*KNOWN_PREFIXES, *CODE_WORDS])
    # Offsets of one value are unique per kind and match, so no duplicate can arise here.
    return owned.where(F.when(F.col("kind") == "unknown-brace", brace).otherwise(token))


def distinct_matches(hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exact copies of a match, as found by runs with different windows, count once."""
    return hits.dropDuplicates([*keys, "kind", "offset", "value"])


def suppress_known(unknown: DataFrame, known: DataFrame, content: str = "content_hash") -> DataFrame:
    """Unknown hits whose value is not already a known hit of the same content."""
    values = known.select(content, F.trim("value").alias("__value")).distinct()
    return unknown.withColumn("__value", F.trim("value")).join(values, [content, "__value"], "left_anti").drop("__value")


BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_bytes(label: Column) -> Column:
    """Bytes of a base32 label: five bits per character, whole bytes kept.  Spark has no builtin for it."""
    bits = F.array_join(
        F.transform(F.split(F.upper(label), ""), lambda c: F.lpad(F.bin(F.instr(F.lit(BASE32), c) - 1), 5, "0")), ""
    )
    digits = F.transform(
        F.sequence(F.lit(0), (F.length(label) * 5 / 8).cast("int") - 1),
        lambda i: F.lpad(F.conv(F.substring(bits, i * 8 + 1, F.lit(8)), 2, 16), 2, "0"),
    )
    return F.unhex(F.array_join(digits, ""))


def _joined_bytes(pieces: Column) -> Column:
    return F.unhex(F.array_join(F.transform(pieces, lambda p: F.hex(p)), ""))


def decode_query_names(df: DataFrame, name: str = "query_name") -> DataFrame:
    """Leading labels that carry one encoding, decoded; at least one plain label must follow them."""
    labels = F.split(F.col(name), "\\.")

    def is_base32(label: Column) -> Column:
        return (F.length(label) >= 16) & F.rlike(label, F.lit("^[A-Za-z2-7]+$"))

    def kind(label: Column) -> Column:
        hexed = (F.length(label) >= 16) & (F.length(label) % 2 == 0) & F.rlike(label, F.lit(HEX))
        # A base32 alphabet label of an impossible length decodes to nothing and ends the run.
        sound = is_base32(label) & (F.length(label) % 8).isin(0, 2, 4, 5, 7)
        url = (
            (F.length(label) >= 24)
            & F.rlike(label, F.lit("^[A-Za-z0-9_-]+$"))
            & F.rlike(label, F.lit("[A-Za-z]"))
            & F.rlike(label, F.lit("[0-9_-]"))
            & (F.length(label) % 4 != 1)
        )
        return F.when(hexed, "hex").when(sound, "base32").when(is_base32(label), F.lit(None)).when(url, "base64url")

    kinds = F.transform(labels, kind)
    first = F.element_at(kinds, 1)
    # Position of the first label with another kind, or none.
    run = F.aggregate(
        kinds,
        F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")),
        lambda state, k: F.struct(
            (state["on"] & F.coalesce(k == first, F.lit(False))).alias("on"),
            (state["n"] + F.when(state["on"] & F.coalesce(k == first, F.lit(False)), 1).otherwise(0)).cast("int").alias("n"),
        ),
    )["n"]
    marked = df.withColumn("__labels", labels).withColumn("__encoding", first).withColumn("__run", run).where(
        "__encoding IS NOT NULL AND __run < size(__labels)"
    )
    taken = F.slice(F.col("__labels"), F.lit(1), F.col("__run"))

    def decoded(label: Column) -> Column:
        padded = F.concat(F.translate(label, "-_", "+/"), F.repeat(F.lit("="), ((4 - F.length(label) % 4) % 4).cast("int")))
        return (
            F.when(F.col("__encoding") == "hex", F.try_to_binary(label, F.lit("hex")))
            .when(F.col("__encoding") == "base32", base32_bytes(label))
            .otherwise(F.try_to_binary(padded, F.lit("base64")))
        )

    common = [
        *df.columns,
        F.col("__encoding").alias("encoding"),
        F.lower(F.array_join(F.slice(F.col("__labels"), F.col("__run") + 1, F.size("__labels")), ".")).alias("base_domain"),
        F.array_join(taken, ".").alias("encoded_name"),
    ]
    return marked.select(*common, _joined_bytes(F.transform(taken, decoded)).alias("chunk"))
