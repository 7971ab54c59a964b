"""Arrow functions for what no expression can say: Unicode forms, all entities, code, shell words, best extents."""

from __future__ import annotations

import html
import re
import shlex
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import grams
from .text import COMMENT, CONTROL, HEADER, IMAGE, LINK, TAG, URL

_CODE = re.compile(r"```.*?```|`[^`\n]+`", re.S)
_BLOCK = re.compile(r"<(script|style)\b[^>]*>.*?</\1\s*>", re.S | re.I)


def clean(text: str | None, strip_html: bool = True, collapse_space: bool = True, drop_urls: bool = False, normalize: bool = True) -> str:
    """Cleans everything between code spans; code stays as written."""
    if not text:
        return ""
    code: list[str] = []

    def stash(m: re.Match) -> str:
        code.append(m[0])
        return f"\ue000{len(code) - 1}\ue001"

    t = _CODE.sub(stash, text)
    if normalize:
        t = unicodedata.normalize("NFKC", t)
    t = re.sub(CONTROL, "", t).replace("\xa0", " ").replace("\u200b", "")
    if strip_html:
        t = re.sub(TAG, " ", _BLOCK.sub(" ", re.sub(COMMENT, " ", t)))
    t = html.unescape(t).replace("\xa0", " ")
    t = re.sub(LINK, r"\1", re.sub(IMAGE, "", t))
    if drop_urls:
        t = re.sub(URL, "", t)
    if collapse_space:
        t = "\n".join(x.strip() for x in re.sub(r"[ \t]+", " ", t).split("\n"))
        t = re.sub(r"\n{3,}", "\n\n", t)
    return re.sub("\ue000(\\d+)\ue001", lambda m: code[int(m[1])], t).strip()


#: Texts of a batch that are Python strings at once.
HELD = 256


@F.arrow_udf(T.StringType())
def clean_text(t: pa.Array) -> pa.Array:
    pieces = [pa.array([clean(x) for x in t.slice(k, HELD).to_pylist()], pa.string()) for k in range(0, len(t), HELD)]
    return pa.concat_arrays(pieces) if pieces else pa.array([], pa.string())


@F.pandas_udf(T.StringType())
def nfkc(t: pd.Series) -> pd.Series:
    return t.str.normalize("NFKC")


@F.pandas_udf(T.StringType())
def unescape(t: pd.Series) -> pd.Series:
    return t.map(html.unescape, na_action="ignore")


def word_similarity(query: str, text: str) -> float:
    """Shared trigrams over all trigrams of the query and the best stretch of the text; those of each word with two blanks before and one after."""
    return grams.best_extent(np.unique(grams.word_trigrams(query)), text)


@F.pandas_udf(T.DoubleType())
def word_similarity_udf(q: pd.Series, t: pd.Series) -> pd.Series:
    return pd.Series([word_similarity(a or "", b or "") for a, b in zip(q, t, strict=True)], dtype="float64")


def shell_words(line: str | None) -> list[str] | None:
    """Words of a command line; null if its quotes don't close."""
    try:
        return shlex.split(line or "")
    except ValueError:
        return None


@F.pandas_udf(T.ArrayType(T.StringType()))
def shell_split(line: pd.Series) -> pd.Series:
    return line.map(shell_words)


def sections_of(markdown: str) -> list[tuple[str | None, str]]:
    """The plain Python form of ``text.sections``, for readers that hold a whole file."""
    out: list[tuple[str | None, str]] = []
    title, body = None, []
    for line in markdown.splitlines():
        if re.match(HEADER, line):
            if body:
                out.append((title, "\n".join(body)))
            title, body = re.sub(HEADER, "", line).strip(), []
        else:
            body.append(line)
    return out + ([(title, "\n".join(body))] if body else [])


def pack_paragraphs(text: str | None, size: int = 1500, overlap: int = 200) -> list[str]:
    """Pieces of whole paragraphs up to ``size``, longer ones cut hard, each with the end of the one before it."""
    text = text or ""
    if len(text) <= size:
        return [text]
    packed: list[str] = []
    for p in text.split("\n\n"):
        if packed and packed[-1] and len(packed[-1]) + len(p) + 2 <= size:
            packed[-1] += "\n\n" + p
        elif packed and not packed[-1]:
            packed[-1] = p
        else:
            packed.append(p)
    cut = [p[i : i + size] for p in packed for i in range(0, len(p), size)]
    if overlap <= 0 or len(cut) < 2:
        return cut
    out = cut[:1]
    for before, own in zip(cut, cut[1:], strict=False):
        tail = before[-overlap:]
        at = tail.find(" ")
        out.append((tail[at + 1 :] if 0 <= at < len(tail) - 1 else tail) + "\n" + own)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def pack_paragraphs_udf(text: pd.Series) -> pd.Series:
    return text.map(pack_paragraphs)
