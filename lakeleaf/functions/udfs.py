"""Arrow UDFs, for the few text functions that Spark lacks."""

from __future__ import annotations

import base64
import difflib
import hashlib
import hmac
import io
import math
import unicodedata
import uuid
import zipfile
from collections import Counter
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType


def nfc_text(text: str | None) -> str | None:
    return unicodedata.normalize("NFC", text) if text else text


def ratio_of(a: str | None, b: str | None) -> float:
    """Gestalt similarity of the NFC lower-case texts; 0 where one is empty.  The order of the arguments matters."""
    if not a or not b:
        return 0.0
    return difflib.SequenceMatcher(None, nfc_text(a).lower(), nfc_text(b).lower()).ratio()


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of the table at a time as the bits of one number.

    A zero bit at i marks that the length grows there.  Memory is a bit per character of a for each distinct one.
    """
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        met = row & places.get(y, 0)
        row = (row + met | row - met) & full
    return len(a) - row.bit_count()


def rouge_l_of(reference: str | None, answer: str | None) -> float:
    """F1 of the longest common subsequence of non-blank characters of whole texts; 0 where one has none."""
    a, b = ("".join((x or "").split()) for x in (reference, answer))
    if not a or not b:
        return 0.0
    lcs = common_subsequence(a, b)
    return 2 * lcs / (len(a) + len(b)) if lcs else 0.0


def bleu_of(reference: str | None, answer: str | None, order: int) -> float:
    """Character BLEU of up to ``order``-grams with add-one smoothing above unigrams and a brevity penalty."""
    a, b = ("".join((x or "").split()) for x in (reference, answer))
    if not a or not b:
        return 0.0
    logs = 0.0
    for n in range(1, order + 1):
        want, got = (Counter(x[i : i + n] for i in range(len(x) - n + 1)) for x in (a, b))
        hits, total = sum((want & got).values()), sum(got.values())
        if n > 1:
            hits, total = hits + 1, total + 1
        if not hits or not total:
            return 0.0
        logs += math.log(hits / total)
    return math.exp(logs / order) * min(1.0, math.exp(1 - len(a) / len(b)))


def point_id_of(name: str | None) -> str | None:
    return None if name is None else str(uuid.uuid5(uuid.NAMESPACE_DNS, name))


def signature_of(payload: str | None, secret: str) -> str | None:
    if payload is None:
        return None
    digest = hmac.new(secret.encode(), payload.encode(), hashlib.sha256).digest()
    return base64.urlsafe_b64encode(digest).decode().rstrip("=")


def docx_text(content: bytes | None) -> str | None:
    """Paragraphs of a DOCX file, by line; null for what is no such file."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
            body = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    return "\n".join("".join(t.text or "" for t in p.iter(f"{space}t")) for p in body.iter(f"{space}p"))


@F.pandas_udf(StringType())
def nfc_all(texts: pd.Series) -> pd.Series:
    return texts.map(nfc_text)


@F.pandas_udf(StringType())
def _folded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else nfc_text(t).lower())


def _beyond_ascii(plain, f, c):
    """plain(c) where a text is ASCII, else what the UDF makes of it; ASCII texts go to Python as nulls."""
    ascii_ = c.rlike(r"^[\x00-\x7F]*$")
    return F.coalesce(F.when(ascii_, plain(c)), f(F.when(~ascii_, c)))


def nfc(c):
    """Text in NFC."""
    return _beyond_ascii(lambda x: x, nfc_all, c)


def folded(c):
    """Text in NFC and lower case, as the ratio compares it."""
    return _beyond_ascii(F.lower, _folded, c)


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio_of(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def best_ratio(a: pd.Series, names: pd.Series) -> pd.Series:
    """The largest ratio of a text to one of several names."""
    return pd.Series([max((ratio_of(x, n) for n in ns), default=0.0) for x, ns in zip(a, names, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def least_best_ratio(wanted: pd.Series, names: pd.Series) -> pd.Series:
    """The smallest of the largest ratios that each wanted text has to one of the names; 0 without names."""
    none = lambda x: x is None or not len(x)
    best = lambda w, ns: max(ratio_of(w, n) for n in ns)
    return pd.Series([0.0 if none(ns) or none(ws) else min(best(w, ns) for w in ws) for ws, ns in zip(wanted, names, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def rouge_l(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([rouge_l_of(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def bleu_1(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([bleu_of(x, y, 1) for x, y in zip(a, b, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def bleu_2(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([bleu_of(x, y, 2) for x, y in zip(a, b, strict=True)], dtype=float)


@F.pandas_udf(StringType())
def point_id(names: pd.Series) -> pd.Series:
    return names.map(point_id_of)


@F.pandas_udf(StringType())
def docx(contents: pd.Series) -> pd.Series:
    return contents.map(docx_text)


def token_signature(payload, secret: str):
    """HMAC-SHA-256 of a column as unpadded base64url."""

    def signed(payloads: pd.Series) -> pd.Series:
        return payloads.map(lambda p: signature_of(p, secret))

    return F.pandas_udf(signed, StringType())(payload)


def spans_of(counts: list[int], target: int, most: int) -> list[tuple[int, int]]:
    """(first sentence, number of sentences) of the chunks of a text, given its sentences' words (O-160)."""
    out, first, words = [], 0, 0
    for i, n in enumerate(counts):
        if i > first and (n > most or words + n > most):
            out.append((first, i - first))
            first, words = i, 0
        words += n
        if words >= target:
            out.append((first, i + 1 - first))
            first, words = i + 1, 0
    if words >= 10:
        out.append((first, len(counts) - first))
    return out


@F.arrow_udf(ArrayType(StructType().add("first", IntegerType()).add("n", IntegerType())))
def chunk_spans(counts, target, most):
    import pyarrow as pa

    found, to, limit = [], target[0].as_py(), most[0].as_py()
    for words in counts:
        found.append(None if not words.is_valid else [{"first": a, "n": n} for a, n in spans_of(words.values.to_pylist(), to, limit)])
    return pa.array(found, pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32())])))
