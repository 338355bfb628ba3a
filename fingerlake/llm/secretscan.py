"""Secrets, found by how badly a tokenizer's vocabulary compresses them.

Prose gives three or more characters a token under a byte-level BPE vocabulary;
keys, tokens and passwords are random and give fewer than two. A run of key
characters that is long enough is tokenised, and its characters-per-token ratio
decides. What is known to be random but harmless is left out first: digests and
commit ids, UUIDs, numbers, addresses, dates.

The ratio that is still suspicious depends on the run's shape: a run that mixes
letters with digits, or cases inside, may have up to ``MIXED_RATIO``; one of
letters in a single case could be a rare word and must be at ``CAPITALS_RATIO`` at
most, or, in lower case, at ``WORD_RATIO`` and from ``LONG_WORD`` characters on at
``LONG_WORD_RATIO``, as the ratio of random letters scatters less the longer they are
(mean 1.67). Assigned to a secret's name it may have ``MIXED_RATIO``. A run shorter than ``MIN_LENGTH`` counts only where it is
assigned to a name such as ``password`` or ``token``.

Cases: null and empty texts have no secrets; the whole of a long text is
searched; a long run is judged in pieces of ``PIECE`` characters by its worst
piece; a run that passes as a whole is judged again by each of its segments between
``/ - _ = +`` and by overlapping windows of ``SHORT`` characters, so that a key behind
a long path is not averaged away; equal rows give equal findings; further columns are
carried through whatever their names.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fingerlake.llm.names import free_name

#: tiktoken rank file; a parameter of every function that needs it.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MIN_LENGTH = 16
MIN_ASSIGNED = 8
MIXED_RATIO = 2.3
CAPITALS_RATIO = 1.85
WORD_RATIO = 1.8
LONG_WORD_RATIO = 2.0
LONG_WORD = 20
PIECE = 256
#: Windows inside a run; each STEP from the last, so one has 24 characters of a key at its start.
SHORT = 32
STEP = 8
MASK = "[SECRET]"

_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_RUN = re.compile(r"(?<!\w)[A-Za-z0-9+/_=-]{%d,}(?!\w)" % MIN_ASSIGNED)
_NAME = r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth(?:orization)?|credentials?|bearer|key)"
_ASSIGNED = re.compile(_NAME + r"[\"']?\s{0,3}(?:[:=]{1,2}>?|\bis\b|\s)\s{0,3}[\"']?$", re.I)
_INLINE = re.compile(r"^([A-Za-z_-]*" + _NAME + r")=+(?=.)", re.I)
_DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_DIGEST_LENGTHS = {32, 40, 56, 64, 96, 128}
_UUID = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")
_NUMBER = re.compile(r"[0-9=_/+-]+")
_WORDS = re.compile(r"(?:[A-Za-z]{0,15}|[0-9]{0,8})(?:[-_/+=](?:[A-Za-z]{0,15}|[0-9]{0,8}))+")
_SEGMENT = re.compile(r"[A-Za-z0-9]+")
_KNOWN = re.compile(r"(?<![A-Za-z0-9])(?:%s|[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9])" % _UUID.pattern)
#: A wider test for the JVM: only texts in which find_secrets cannot find anything stay away from
#: Python. The gap holds whatever may end a name and stand before its value, line breaks too.
_PREFILTER = r"[A-Za-z0-9+/_=-]{%d}|(?isu)(?:pass|pwd|secret|token|key|auth|cred|bearer).{0,32}[A-Za-z0-9+/_=-]{%d}" % (MIN_LENGTH, MIN_ASSIGNED)


@lru_cache(maxsize=4)
def tokenizer(path: str = VOCABULARY):
    """A tiktoken encoding over the rank file at ``path``."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


def chars_per_token(run: str, path: str = VOCABULARY) -> float:
    """The lowest ratio of the run's pieces; the last piece is a full one too."""
    enc = tokenizer(path)
    if len(run) <= PIECE:
        return len(run) / len(enc.encode_ordinary(run))
    cuts = [*range(0, len(run) - PIECE, PIECE), len(run) - PIECE]
    return min(PIECE / len(enc.encode_ordinary(run[i : i + PIECE])) for i in cuts)


def _mixed(run: str) -> bool:
    has_digit = any(c.isdigit() for c in run)
    has_alpha = any(c.isalpha() for c in run)
    inner = run[1:]
    return (has_digit and has_alpha) or (any(c.isupper() for c in inner) and any(c.islower() for c in inner))


def _random(body: str, ratio: float, assigned: bool) -> bool:
    if assigned or _mixed(body):
        return ratio <= MIXED_RATIO
    if body.isupper():
        return ratio <= CAPITALS_RATIO
    return ratio <= (LONG_WORD_RATIO if len(body) >= LONG_WORD else WORD_RATIO)


def _known(body: str) -> bool:
    """Words, numbers, ids and digests."""
    return bool(_NUMBER.fullmatch(body) or _UUID.fullmatch(body) or _WORDS.fullmatch(body) or (len(body) in _DIGEST_LENGTHS and _DIGEST.fullmatch(body)))


def _inner(body: str, path: str) -> list[tuple[int, int, float]]:
    """(start, end, ratio) of the keys inside a run that passes as a whole.

    A window's find is widened to the segments that it touches; ids and digests
    are cut out first.
    """
    segments = [m.span() for m in _SEGMENT.finditer(body)]
    hits = []
    for a, b in segments:
        if b - a >= MIN_LENGTH and not _known(body[a:b]):
            ratio = chars_per_token(body[a:b], path)
            if _random(body[a:b], ratio, False):
                hits.append((a, b, ratio))
    known = [m.span() for m in _KNOWN.finditer(body) if _known(m.group())]
    lo = 0
    for a, b in [*known, (len(body), len(body))]:
        if a - lo > SHORT:
            for i in [*range(lo, a - SHORT, STEP), a - SHORT]:
                part = body[i : i + SHORT]
                if _known(part):
                    continue
                ratio = chars_per_token(part, path)
                if _random(part, ratio, False):
                    touched = [(x, y) for x, y in segments if x < i + SHORT and y > i]
                    x, y = (touched[0][0], touched[-1][1]) if touched else (i, i + SHORT)
                    # Of one long segment only the windows that were found.
                    hits.append((max(x, i) if i - x > PIECE else x, min(y, i + SHORT) if y - i - SHORT > PIECE else y, ratio))
        lo = b
    out: list[tuple[int, int, float]] = []
    for a, b, ratio in sorted(hits):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), min(ratio, out[-1][2]))
        else:
            out.append((a, b, ratio))
    return out


def find_secrets(text: str | None, path: str = VOCABULARY) -> list[tuple[int, int, float]]:
    """(start, end, characters per token) of each secret in ``text``."""
    out = []
    for m in _RUN.finditer(text or ""):
        start, end = m.span()
        run = m.group()
        assigned = False
        if inline := _INLINE.match(run):
            start += inline.end()
            assigned = True
        elif _ASSIGNED.search(text[max(0, start - 40) : start]):
            assigned = True
        run = text[start:end].rstrip("=-_/+")
        body = run.lstrip("=-_/+")
        start += len(run) - len(body)
        end = start + len(body)
        if len(body) < (MIN_ASSIGNED if assigned else MIN_LENGTH):
            continue
        if _NUMBER.fullmatch(body) or _UUID.fullmatch(body):
            continue
        if not assigned and (_WORDS.fullmatch(body) or (len(body) in _DIGEST_LENGTHS and _DIGEST.fullmatch(body))):
            continue
        if len(body) < MIN_LENGTH and not _mixed(body):
            continue
        ratio = chars_per_token(body, path)
        if _random(body, ratio, assigned):
            out.append((start, end, ratio))
        elif not _WORDS.fullmatch(body):
            out += [(start + a, start + b, r) for a, b, r in _inner(body, path)]
    return out


def redact(text: str, path: str = VOCABULARY) -> str:
    """``text`` with every secret replaced by ``MASK``."""
    out, at = [], 0
    for start, end, _ in find_secrets(text, path):
        out += [text[at:start], MASK]
        at = end
    return "".join([*out, text[at:]])


_FOUND = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("masked", T.StringType()), T.StructField("ratio", T.DoubleType())]))


def _finder(path: str) -> Callable:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("masked", pa.string()), ("ratio", pa.float64())]))

    @F.arrow_udf(_FOUND)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:
            out = []
            for v in values:
                t = v.as_py()
                out.append(None if t is None else [{"start": a, "end": b, "masked": t[a : a + 4] + "*" * (b - a - 4), "ratio": r} for a, b, r in find_secrets(t, path)])
            yield pa.array(out, kind)

    return find


def _redactor(path: str) -> Callable:
    @F.arrow_udf(T.StringType())
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:
            yield pa.array([None if t is None else redact(t, path) for t in (v.as_py() for v in values)], pa.string())

    return clean


def _suspects():
    return F.when(F.col("text").rlike(_PREFILTER), F.col("text"))


def secrets(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``(doc_id, start, end, masked, chars_per_token)``, a row for each secret.

    Offsets count characters from 0, the end excluded; ``masked`` shows the first
    four characters.
    """
    found = docs.select("doc_id", "text").where(F.col("text").rlike(_PREFILTER)).select("doc_id", F.explode(_finder(path)("text")).alias("s"))
    return found.select("doc_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.masked").alias("masked"), F.col("s.ratio").alias("chars_per_token"))


def redact_secrets(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``docs`` with secrets masked in ``text``; all rows and columns stay.

    ``n_chars`` follows the new text where that changed.
    """
    name = free_name(docs, "__new")
    new = docs.withColumn(name, _redactor(path)(_suspects()))
    changed = F.col(name).isNotNull() & (F.col(name) != F.col("text"))
    cols = []
    for c in docs.columns:
        if c == "text":
            cols.append(F.coalesce(name, "text").alias(c))
        elif c == "n_chars":
            cols.append(F.when(changed, F.length(name).cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(f"`{c}`"))
    return new.select(*cols)
