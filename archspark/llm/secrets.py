"""Secret scans: base patterns plus a battery of randomness tests on other tokens.

Base spans come from three fixed patterns. Beyond them every run of key characters of at
least ``shortest`` characters with letters and digits is a candidate. Its encoding is inferred
(digits, hex, base32, base64), and three tests ask whether its characters look drawn at random
from that alphabet:

* chi-squared: all characters of the alphabet equally frequent;
* runs: as many changes between the lower and the upper half of the alphabet as chance gives;
* serial correlation: neighbouring characters independent.

The smallest of the three p-values, times three, is the token's p-value; random tokens spread
over (0, 1], words and identifiers fall near 0. Short tokens have weak tests, so false
discoveries are controlled by length: over the whole corpus the p-values of the distinct tokens of
each (encoding, length band) are counted in a histogram, so a copied token has one vote; the count above one half estimates the number of
random tokens, and the band's threshold is the smallest p-value at which the estimated share of
ordinary tokens among those accepted stays below ``fdr``. Tokens of p below ``UNLIKELY`` have a bin of
their own, -1: few distinct ordinary tokens pass as a share of many random ones, so this bin is accepted
only if ``fdr`` holds within it. Spark counts distinct token hashes; the table of
thresholds is bounded by encodings times bands times bins.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archspark.llm.common import annotate, small_batches

#: fixed patterns
ASSIGN = re.compile(r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
                    r"|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a maximal run; shorter ones would be dropped
DIGITS = re.compile(r"[0-9]+")
KEY_RUN = re.compile(r"[A-Za-z0-9+/_-]*")
KEY_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")
KINDS = ("assign", "access", "hex")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

MARK = "[secret]"
BINS = 20
UNLIKELY = 0.001
BAND = 4
ALPHABETS = {
    "digit": "0123456789",
    "hex": "0123456789abcdef",
    "base32": "234567ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base64": "+/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
}
RANK = {k: {c: i for i, c in enumerate(a)} for k, a in ALPHABETS.items()}


def _mentions(low: str) -> bool:
    return any(k in low for k in KEYWORDS)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted; leftmost non-overlapping per kind, failing matches dropped."""
    out = []
    if (":" in text or "=" in text) and _mentions(text.lower()):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, shortest: int) -> list[tuple[int, int, str]]:
    """Runs of key characters with a digit and a letter, padding left out; grown from each digit."""
    out, done = [], 0
    for m in DIGITS.finditer(text):
        start, end = m.span()
        if start < done:
            continue
        while start > done and text[start - 1] in KEY_CHARS:
            start -= 1
        done = end = KEY_RUN.match(text, end).end()
        token = text[start:end]
        if end - start >= shortest and any(c.isalpha() for c in token):
            out.append((start, end, token))
    return out


def encoding(token: str) -> tuple[str, str]:
    """(encoding, token as written in its alphabet): the smallest alphabet that holds the token."""
    if token.isdigit():
        return "digit", token
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", token):
        return "hex", token.lower()
    if re.fullmatch(r"[A-Z2-7]+", token):
        return "base32", token
    return "base64", token.replace("-", "+").replace("_", "/")


def _tail_normal(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _tail_chi2(x: float, df: int) -> float:
    """Upper tail by Wilson and Hilferty's cube root."""
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return math.erfc(z / math.sqrt(2)) / 2


def randomness(token: str, kind: str) -> float:
    """Bonferroni-combined p-value of the three tests; 1: nothing speaks against randomness."""
    rank = RANK[kind]
    x = [rank.get(c, 0) for c in token]
    n, k = len(x), len(rank)
    expect = n / k
    # with few characters per cell the statistic's own variance replaces the chi-squared one
    chi = sum((c - expect) ** 2 for c in Counter(x).values()) / expect + (k - len(set(x))) * expect
    sd = math.sqrt(2 * (k - 1) * (n - 1) / n)
    uniform = min(1.0, _tail_chi2(max(chi, 1e-9), k - 1) if expect >= 5 else math.erfc((chi - (k - 1)) / sd / math.sqrt(2)) / 2)
    high = [v >= k / 2 for v in x]
    up = sum(high)
    down = n - up
    if min(up, down) == 0:
        runs = 2.0 ** (1 - n)
    else:
        mean = 2 * up * down / n + 1
        var = max((mean - 1) * (mean - 2) / (n - 1), 1e-9)
        runs = _tail_normal((1 + sum(a != b for a, b in zip(high, high[1:])) - mean) / math.sqrt(var))
    mid = sum(x) / n
    spread = sum((v - mid) ** 2 for v in x)
    if spread == 0:
        serial = 0.0
    else:
        r = sum((a - mid) * (b - mid) for a, b in zip(x, x[1:])) / spread
        serial = _tail_normal((r + 1 / n) * math.sqrt(n))
    return min(1.0, 3 * min(uniform, runs, serial))


def tested(text: str, base: list[tuple[int, int, int]], shortest: int):
    """(start, end, encoding, length band, p-value bin) of each candidate outside the base spans."""
    for start, end, token in candidates(text, shortest):
        if any(start < e and s < end for s, _, e in base):
            continue
        kind, written = encoding(token)
        p = randomness(written, kind)
        yield start, end, kind, min(len(token) // BAND, 64), min(int(p * BINS), BINS - 1) if p >= UNLIKELY else -1


def histogram(docs: DataFrame, shortest: int, text_col: str) -> DataFrame:
    """(kind, band, bin, n) over the distinct candidates of the whole corpus."""
    def run(batches):
        sent: set[int] = set()  # spares rows only: Spark makes the hashes distinct
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                for start, end, *cell in tested(text, base_spans(text), shortest):
                    h = int.from_bytes(xxhash.xxh64_digest(text[start:end]), "big", signed=True)
                    if h in sent:
                        continue
                    if len(sent) < 200_000:
                        sent.add(h)
                    rows.append((h, *cell))
            cols = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), *(pa.array(c, pa.int64()) for c in cols[2:])],
                                             names=["h", "kind", "band", "bin"])

    small_batches(docs.sparkSession)
    tokens = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "h long, kind string, band long, bin long").distinct()
    return tokens.groupBy("kind", "band", "bin").agg(F.count("*").alias("n"))


def thresholds(counts: dict[tuple[str, int], list[int]], fdr: float) -> dict[tuple[str, int], int]:
    """Smallest accepted bin of each (encoding, band); BINS where no bin keeps the rate. Lists start with bin -1."""
    out = {}
    for key, (unlikely, *n) in counts.items():
        random = sum(n[BINS // 2 :]) / 0.5  # random tokens have p-values spread evenly
        out[key] = BINS
        for b in range(BINS // 2, -1, -1):
            taken = sum(n[b:])
            wrong = max(0.0, taken - random * (1 - max(b / BINS, UNLIKELY)))
            if taken and wrong / taken <= fdr:
                out[key] = b
        if out[key] == 0 and unlikely and (unlikely - random * UNLIKELY) / unlikely <= fdr:
            out[key] = -1
    return out


def find_secrets(docs: DataFrame, *, shortest: int = 20, fdr: float = 0.05, id_col: str = "doc_id", text_col: str = "text",
                 carry: tuple[str, ...] = ()) -> DataFrame:
    """id, carried columns, spans (array of start, k, end; code points, end exclusive), redacted text.

    k counts the kinds assign, access, hex; 3 is a random token. Spans are sorted by start, then k. Null texts have no spans and
    stay null; empty texts have none; repeated rows each get their row (and one vote in
    the histogram); an empty table gives an empty result. Other columns are not read.
    """
    counts: dict[tuple[str, int], list[int]] = {}
    for r in histogram(docs, shortest, text_col).collect():  # at most 4 encodings x 65 bands x 21 bins
        counts.setdefault((r["kind"], r["band"]), [0] * (BINS + 1))[r["bin"] + 1] = r["n"]
    least = thresholds(counts, fdr)

    def make():
        def work(texts):
            spans, redacted = [], []
            for text in texts.to_pylist():
                base = base_spans(text or "")
                more = [(s, 3, e) for s, e, kind, band, b in tested(text or "", base, shortest) if b >= least.get((kind, band), BINS)]
                found = sorted(base + more)
                spans.append([{"start": s, "k": k, "end": e} for s, k, e in found])
                redacted.append(redact(text, found) if found else text)
            return spans, redacted

        return work

    return annotate(docs, make, "spans array<struct<start int, k int, end int>>, redacted string",
                    id_col=id_col, text_col=text_col, carry=carry)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every (merged) span replaced by a mark."""
    out, at = [], 0
    for start, _, end in spans:
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], MARK]
        at = end
    return "".join(out) + text[at:]
