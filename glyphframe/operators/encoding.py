"""Encodings, normalization and escapes."""

from __future__ import annotations

import codecs
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphframe.functions import kernels
from glyphframe.functions.patterns import text


def charset(encoding: str) -> str:
    """The usual name of a charset; an error if it is unknown."""
    if not isinstance(encoding, str):
        raise TypeError("`encoding` must be a single string.")
    return codecs.lookup(encoding).name


def str_conv(binary, encoding: str) -> Column:
    """Bytes in a charset as text; bytes that the charset does not have become U+FFFD."""
    b = (F.col(binary) if isinstance(binary, str) else binary).cast("binary")
    name = charset(encoding)
    if name == "utf-8":
        return F.make_valid_utf8(b.cast("string"))
    if name == "iso8859-1":
        return F.decode(b, "ISO-8859-1")

    @F.pandas_udf(T.StringType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else bytes(x).decode(name, "replace"))

    return run(b)


def str_encode(string, encoding: str) -> Column:
    """Text as bytes in a charset."""
    s, name = text(string), charset(encoding)
    if name == "utf-8":
        return F.encode(s, "UTF-8")

    @F.pandas_udf(T.BinaryType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else x.encode(name, "replace"))

    return run(s)


def enc_info(encoding: str) -> dict:
    """Name, other names and properties of a charset."""
    from encodings.aliases import aliases

    name = charset(encoding)
    probe = bytes(range(128))
    try:
        ascii_like = probe.decode(name) == probe.decode("ascii")
    except UnicodeDecodeError:
        ascii_like = False
    single = False
    try:
        single = all(len(bytes([i]).decode(name, "replace")) == 1 for i in range(256)) and not name.startswith("utf")
    except (UnicodeDecodeError, LookupError):
        pass
    own = aliases.get(name.replace("-", "_"), name.replace("-", "_"))
    return {"name": name, "aliases": sorted({own, *(k for k, v in aliases.items() if v == own)}), "ascii_superset": ascii_like, "single_byte": single}


def enc_get() -> str:
    """The encoding of all text."""
    return "utf-8"


def trans_nfc(string) -> Column:
    """Canonical composition; ASCII text never leaves the JVM."""
    s = text(string)
    ascii_text = F.octet_length(s) == F.length(s)
    composed = kernels.mapped(T.StringType(), lambda t: unicodedata.normalize("NFC", t), F.when(~ascii_text, s))
    return F.when(ascii_text, s).otherwise(composed)


def str_escape(string) -> Column:
    """Text with a backslash before what a regular expression would not take literally."""
    return F.regexp_replace(text(string), r"([.^$\\|*+?{}\[\]()])", r"\\$1")


#: Escapes with a letter of their own.
LETTERS = {7: "a", 8: "b", 9: "t", 10: "n", 11: "v", 12: "f", 13: "r", 34: '"', 39: "'", 92: "\\"}


def escape_unicode(string) -> Column:
    """Printable ASCII as it is, all else as an escape."""
    s = text(string)
    letters = F.create_map(*[F.lit(x) for code, letter in LETTERS.items() for x in (code, "\\" + letter)])

    def one(c: Column) -> Column:
        code = F.ascii(c)
        return (
            F.when(F.try_element_at(letters, code).isNotNull(), F.try_element_at(letters, code))
            .when((code >= 32) & (code <= 126), c)
            .when(code <= 0xFFFF, F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0")))
            .otherwise(F.concat(F.lit("\\U"), F.lpad(F.lower(F.hex(code)), 8, "0")))
        )

    return F.when(F.rlike(s, F.lit(r"^[ !#-&(-\[\]-~]*\z")), s).otherwise(F.array_join(F.transform(F.split(s, ""), one), ""))
