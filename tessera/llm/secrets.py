"""Operator 6: secret scans with a guess-cost model of passwords.

Fixed patterns give spans of kinds assign, access and hex.  Beside them, each value
that stands in a credential context (a word such as password, pwd, passphrase,
auth or bearer, then a separator) is judged by dynamic programming: the least
sum of log10 guesses over its segmentations into dictionary words (by rank, see ``ranks``), marks, dates,
repeats, keyboard walks and brute-force spans, plus the orderings of the segments.  A value at or over
``least_log10`` is a span of kind guess: such strings aren't placeholders or plain words.

Behind a bare blank or ``is``, which prose has too, only a value with a digit, or with a sign inside it, is judged: words
there are prose in any language.

A value ends before its closing quote, or, without one, before the first blank, quote, angle
bracket, comma or semicolon; behind auth and authorization the word after the scheme is judged too.  A keyword that
another keyword's value begins with is a context of its own.

Spans count code points of the text as given, ends exclusive.  An assign span is the whole
match.  Cases: null or empty text has no spans; null doc_id passes through;
repeated rows are scanned alike; an empty table gives no rows; values of any length are
segmented whole, and left early only where every continuation stays at or over the threshold.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
import re
from functools import lru_cache
from heapq import heappop, heappush
from itertools import zip_longest

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, strings
from tessera.llm.tokens import vocabulary_file

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
# A keyword and its separator.
CONTEXT = re.compile(r"(?<![A-Za-z0-9])(pass(?:word|wd|phrase|code)?|pwd|pin|secret|token|api[_-]?key|access[_-]?key|auth|authorization|bearer|credentials?|private[_-]?key)[\"']?(?P<mark>\x20*(?:=>|[:=])\x20*|\x20is\x20|\x20)", re.IGNORECASE | re.ASCII)
# What a value behind a bare blank has and a word of prose has not: a digit, or a sign other than the joints of words before its last letter.
UNLIKE_PROSE = re.compile(r"[(\[]*+[^\W\d_]*+(?:[-'’./_][^\W\d_]++)*+[-'’./_]?(?:\d|[^\w\s.!?:)\]-].*\w)")
BARE = re.compile(r"[^\s\"'<>,;]*+")
# What stands before a closing quote of the same line; an apostrophe inside a word closes nothing.
QUOTED = {'"': re.compile(r"(?:\\.|[^\"\\\r\n])*+(?=\"(?!\w))"), "'": re.compile(r"(?:\\.|[^'\\\r\n]|(?<=\w)'(?=\w))*+(?=')")}
BEARER = re.compile(r"bearer\x20", re.IGNORECASE | re.ASCII)
SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9-]*+\x20++")
CONTEXT_HINTS = ("pass", "pwd", "pin", "secret", "token", "key", "auth", "bearer", "credential")
LEAST_LOG10 = 9.0

# Common words of passwords, most frequent first, ranked before all other words.
WORDS = (
    "password qwerty admin welcome login letmein monkey dragon master hello secret token "
    "changeme example test user root pass guest default sample dummy temp public private "
    "shadow sunshine princess football baseball soccer hockey superman batman trustno "
    "love money computer internet server database system access account office company "
    "summer winter spring autumn monday friday january july august december freedom "
    "whatever flower cookie cheese orange banana apple pepper ginger purple silver golden "
    "tiger eagle horse rabbit lucky happy angel star moon magic power hunter ranger "
    "the and you your here none null true false value string insert enter replace"
).split()
# Marks that prose has beside words.
MARKS = ".:!?()[]-/_*"
# Rows of the usual keyboard, and plain successions.
WALKS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "abcdefghijklmnopqrstuvwxyz", "qazwsxedcrfvtgbyhnujmikolp")
# Letters commonly written as other signs.
LEET = str.maketrans("013457@$!", "oleastasi")
STEP = {w[k : k + 2] for row in WALKS for w in (row, row[::-1]) for k in range(len(w) - 1)}
DATE = re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d)")


# A part of 1 to 8 characters twice or more, and a walk, as long as they go on.
AGAIN = [re.compile(rf"(.{{{size}}})\1++", re.DOTALL) for size in range(1, 9)]
WALK = re.compile("(?:" + "|".join(f"{a}(?=[{''.join(sorted(w[1] for w in STEP if w[0] == a))}])" for a in sorted({w[0] for w in STEP})) + ")*+.", re.DOTALL)


@lru_cache(maxsize=1)
def ranks() -> tuple[dict[str, int], int]:
    """Words by rank, which is what a word costs in guesses, and the length of the longest.

    Behind WORDS come the words that begin with a blank in two public vocabularies, an English one and one of
    many languages, in turns; a vocabulary lists frequent words first."""
    with open(vocabulary_file("byte_bpe_50k.json"), encoding="utf-8") as f:
        english = json.load(f)["model"]["vocab"]
    with open(vocabulary_file("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        many = {base64.b64decode(token).decode("utf-8", "replace"): int(rank) for token, rank in map(bytes.split, f)}
    lists = [[t[1:].lower() for t in sorted(v, key=v.get) if t[0] == blank and len(t) > 3 and t[1:].isalpha()] for v, blank in (({t: i for t, i in english.items() if t[1:].isascii()}, "Ġ"), (many, " "))]
    words = dict.fromkeys([*WORDS, *(w for pair in zip_longest(*lists) for w in pair if w)])
    return {w: k + 1 for k, w in enumerate(words)}, max(map(len, words))


def _pool(c: str) -> int:
    return 10 if c.isdigit() and c.isascii() else 26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 100


def _orders(k: int) -> float:
    return math.lgamma(k + 1) / math.log(10)


def _begin(value: str, low: str, plain: str, i: int) -> list[tuple[int, int, float, str]]:
    """The segments other than brute force that begin at i."""
    found, n = [], len(value)
    rank_of, longest = ranks()
    if value[i] in MARKS:
        found.append((i, i + 1, math.log10(_pool(value[i])), "mark"))
    for j in range(i + 3, min(n, i + longest) + 1):
        rank = rank_of.get(low[i:j]) or rank_of.get(plain[i:j])
        if rank:
            case = sum(c.isupper() for c in value[i:j])
            odd = low[i:j] not in rank_of
            found.append((i, j, math.log10(rank * (1 if not case else 2 if value[i].isupper() and case == 1 else 2**case) * (4 if odd else 1) + 1), "word"))
    for size, again in enumerate(AGAIN, 1):  # a part, again and again
        m = again.match(value, i)
        if m and m.end() - i >= 3:
            found.append((i, m.end(), math.log10(sum(map(_pool, m[1])) ** min(size, 4) * (m.end() - i) // size + 1), "repeat"))
    m = WALK.match(low, i)
    if m and m.end() - i >= 3:
        found.append((i, m.end(), math.log10(47 * (m.end() - i) * 8), "walk"))
    m = DATE.match(value, i)
    if m:
        found.append((i, m.end(), math.log10(365 * 120 if len(m[0]) > 4 else 120), "date"))
    return found


def segments(value: str) -> list[tuple[int, int, float, str]]:
    """All dictionary, mark, date, repeat and walk segments: start, end, log10 guesses, class."""
    low = value.lower()
    plain = low.translate(LEET)
    return [x for i in range(len(value)) for x in _begin(value, low, plain, i)]


@lru_cache(maxsize=20_000)
def guess_cost(value: str, enough: float = math.inf) -> float:
    """log10 of the least guesses over all segmentations of the whole value, or ``enough`` if they aren't fewer.

    Costs only grow along a segmentation: a beginning that already costs ``enough``, or as much as a whole
    segmentation that is known, is followed no further."""
    n, low = len(value), value.lower()
    plain = low.translate(LEET)
    if not n:
        return 0.0
    least = 1.0  # of the segmentations seen: at first, all by brute force
    for c in value:
        least += math.log10(_pool(c))
        if least >= enough:
            break
    least = min(least, enough)
    # live[j][k]: least cost of the first j characters in k segments; orderings cost log10 k!.
    live: dict[int, dict[int, float]] = {0: {0: 0.0}}
    ends = [0]
    while ends:
        i = heappop(ends)
        at = {k: cost for k, cost in live.pop(i).items() if cost + _orders(k) < least}
        if not at:
            continue
        lowest, steps = min(at.values()), [(j, cost) for _, j, cost, _ in _begin(value, low, plain, i)]
        brute, j = 1.0, i
        while j < n:
            brute += math.log10(_pool(value[j]))
            j += 1
            if lowest + brute >= least:
                break
            steps.append((j, brute))
        for j, step in steps:
            for k, cost in at.items():
                total = cost + step
                if total + _orders(k + 1) >= least:
                    continue
                if j == n:
                    least = total + _orders(k + 1)
                    continue
                if j not in live:
                    live[j] = {}
                    heappush(ends, j)
                if total < live[j].get(k + 1, math.inf):
                    live[j][k + 1] = total
    return least


def _opens(text: str, at: int) -> tuple[int, int | None]:
    """Begin of the value at a place, and its end if it stands in quotes."""
    quoted = QUOTED.get(text[at : at + 1])
    if quoted:
        at += 1
        if m := quoted.match(text, at):
            scheme = BEARER.match(text, at, m.end())
            return scheme.end() if scheme else at, m.end()
    return at, None


def guesses(text: str, least_log10: float = LEAST_LOG10) -> list[tuple[int, int]]:
    """Begins and ends of the values in credential contexts that cost ``least_log10`` or more.

    The search goes on behind a value that is a span, and else behind the keyword.  Where a value begins with
    a keyword and separator of its own, the inner value goes first and the outer counts only if that one is none."""
    found, at = [], 0

    def judge(begin: int, end: int | None, marked: bool) -> bool:
        nonlocal at
        bare = end is None
        end = BARE.match(text, begin).end() if bare else end
        strong = end - begin >= 6 and (marked or not bare or UNLIKE_PROSE.match(text, begin, end) is not None) and guess_cost(text[begin:end], least_log10) >= least_log10
        if strong:
            found.append((begin, end))
            at = max(at, end)
        return strong

    while m := CONTEXT.search(text, at):
        chain = [(m, *_opens(text, m.end()))]
        while chain[-1][2] is None and (m := CONTEXT.match(text, chain[-1][1])):
            chain.append((m, *_opens(text, m.end())))
        at = chain[-1][0].end(1)
        for m, begin, end in reversed(chain):
            marked = m["mark"].strip() in (":", "=", "=>")
            strong = judge(begin, end, marked)
            if m[1].lower().startswith("auth") and end is None and (scheme := SCHEME.match(text, begin)) and scheme.end() >= at and not CONTEXT.match(text, scheme.end()):
                strong |= judge(*_opens(text, scheme.end()), marked)
            if strong:
                break
    return found


def scan(text: str, least_log10: float = LEAST_LOG10) -> list[tuple[int, str, int, str]]:
    """Spans as (start, kind, end, secret value), by start and then kind as listed."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    low = text.lower()
    if any(h in low for h in CONTEXT_HINTS):
        found += [(begin, 3, end, text[begin:end]) for begin, end in guesses(text, least_log10)]
    return [(s, KINDS[k], e, v) for s, k, e, v in sorted(found)]


def redact(text: str, spans: list[tuple[int, str, int, str]], mark: str = "[SECRET]") -> str:
    """The text with every secret value, overlapping ones together, replaced by the mark."""
    holes: list[list[int]] = []
    for begin, end in sorted((text.index(v, s, e), text.index(v, s, e) + len(v)) for s, _, e, v in spans):
        if holes and begin <= holes[-1][1]:
            holes[-1][1] = max(holes[-1][1], end)
        else:
            holes.append([begin, end])
    out, at = [], 0
    for begin, end in holes:
        out += [text[at:begin], mark]
        at = end
    return "".join([*out, text[at:]])


def _digest(spans: list[tuple[int, str, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e, _ in spans)


def scan_documents(docs: DataFrame, *, least_log10: float = LEAST_LOG10) -> DataFrame:
    """Per document: counts of base spans, the base digest, and all spans."""
    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string"

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows: list[list] = [[] for _ in range(6)]
            for text in strings(batch.column(1)).to_pylist():
                spans = scan(text, least_log10)
                base = [x for x in spans if x[1] != "guess"]
                values = (*(sum(x[1] == k for x in spans) for k in KINDS), hashlib.sha256(_digest(base).encode()).hexdigest(), _digest(spans))
                for column, value in zip(rows, values):
                    column.append(value)
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in rows[:4]), *(pa.array(c, pa.string()) for c in rows[4:])], names=["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans"])

        return step

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), make, schema)


def redacted(text: Column, *, least_log10: float = LEAST_LOG10, mark: str = "[SECRET]") -> Column:
    """The text column without its secrets; null stays null."""
    def run(column: pa.Array) -> pa.Array:
        return pa.array([t if t is None or not (spans := scan(t, least_log10)) else redact(t, spans, mark) for t in column.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(text.cast("string"))


def op6_guess_cost_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
