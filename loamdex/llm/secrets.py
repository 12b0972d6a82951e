"""Secret scans: fixed patterns, and a battery of randomness tests for other tokens.

Long tokens get an encoding by their characters. Three tests ask whether a token looks drawn
at random from that alphabet: chi-squared uniformity over ranges of the alphabet, the
Wald-Wolfowitz runs test over its kinds of characters (capitals, small letters, digits, signs; of
one kind, over its halves), and lag-one serial correlation; Fisher's method combines them. How
often ordinary text passes depends on length and encoding, so it is measured: all short pieces
of all texts, digits and signs included, are glued as words, slugs, identifiers and paths are,
and cut into tokens of each length band. Within a band and encoding, the passing level is the
lowest at which the expected share of ordinary text among what passes stays under FALSE_SHARE
(Benjamini-Hochberg on the measured rates, see passing_levels).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamdex.llm.textops import checkpointed, sha256_of, whole
from loamdex.llm.workers import map_texts

KINDS = ("assign", "access", "hex", "random")
#: The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
#: Letters by how common they are in texts, so that a range of an alphabet holds letters that texts use alike often; random tokens use all ranges alike.
SMALL = "etaoinsrhldcumfpgwybvkxjqz"
CAPITALS, DIGITS = SMALL.upper(), "0123456789"
#: Encodings by alphabet, narrowest first.
ALPHABETS = {
    "hex": DIGITS + "abcdef", "HEX": DIGITS + "ABCDEF", "alpha": SMALL, "ALPHA": CAPITALS,
    "base32": CAPITALS + "234567", "base36": DIGITS + SMALL, "BASE36": DIGITS + CAPITALS,
    "mixed": CAPITALS + SMALL, "base62": CAPITALS + SMALL + DIGITS,
    "base64": CAPITALS + SMALL + DIGITS + "+/", "base64url": CAPITALS + SMALL + DIGITS + "-_", "any": CAPITALS + SMALL + DIGITS + "+/-_",
}
_PLACES = {name: {c: i for i, c in enumerate(a)} for name, a in ALPHABETS.items()}


def _kinds(alphabet: str) -> list[int]:
    """What the runs test tells apart, for each character of an alphabet."""
    kind = [c.isupper() + 2 * c.islower() + 3 * c.isdigit() for c in alphabet]
    return kind if len(set(kind)) > 1 else [int(2 * i >= len(alphabet)) for i in range(len(alphabet))]


_RUN_KINDS = {name: _kinds(a) for name, a in ALPHABETS.items()}
BANDS = (20, 28, 40, 64, 100)
LEVELS, LEAST_P, FALSE_SHARE = 40, 0.01, 0.05
#: Below so many ordinary tokens a rate isn't measured; where a whole band has fewer, tokens pass at SMALL_P.
LEAST_ORDINARY, SMALL_P = 200, 0.05
#: Ordinary pieces, too short to be candidates, and what holds them together, in turns of STRETCH pieces.
PIECE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{1,19}(?![A-Za-z0-9+/_-])")
GLUES, STRETCH = ("", "-", "_", "/"), 64
#: Rows of tokens that are tested at once.
ROWS = 16_384


def chi2_tail(x: float, df: int) -> float:
    """P(chi-squared > x) for an even number of degrees of freedom."""
    half, term, total = x / 2, 1.0, 1.0
    for i in range(1, df // 2):
        term *= half / i
        total += term
    return min(1.0, math.exp(-half) * total) if half < 700 else 0.0


def two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def encoding(token: str) -> str | None:
    """The narrowest alphabet; none for digits alone."""
    body = set(token.rstrip("="))
    return None if not body or body <= set("0123456789") else next(n for n, p in _PLACES.items() if body <= p.keys())


def randomness(token: str, name: str) -> float:
    """Fisher's combination of the three tests' p-values: small for what isn't random."""
    place, body = _PLACES[name], token.rstrip("=")
    x, m, n = [place[c] for c in body], len(place), len(body)
    k = 5 if n < 32 else 9
    seen, size = [0] * k, [0] * k
    for i in range(m):
        size[i * k // m] += 1
    for i in x:
        seen[i * k // m] += 1
    uniform = chi2_tail(sum((s - n * w / m) ** 2 / (n * w / m) for s, w in zip(seen, size)), k - 1)
    kind = [_RUN_KINDS[name][i] for i in x]
    each = [kind.count(c) for c in range(4)]
    runs, squares, cubes = 1 + sum(a != b for a, b in zip(kind, kind[1:])), sum(c * c for c in each), sum(c**3 for c in each)
    mean = n + 1 - squares / n
    spread = (squares * (squares + n * (n + 1)) - 2 * n * cubes - n**3) / (n * n * (n - 1))
    p_runs = two_sided((runs - mean) / math.sqrt(spread)) if spread > 1e-9 else two_sided(math.sqrt(n))
    mid = sum(x) / n
    power = sum((i - mid) ** 2 for i in x)
    serial = sum((a - mid) * (b - mid) for a, b in zip(x, x[1:])) / power if power else 1.0
    p_serial = two_sided((serial + 1 / n) * math.sqrt(n))
    return chi2_tail(-2 * sum(math.log(max(p, 1e-300)) for p in (uniform, p_runs, p_serial)), 6)


def level(p: float) -> int:
    """p-values in LEVELS steps, by logarithm down to 1e-8: the higher, the more random."""
    return max(0, min(LEVELS - 1, int((math.log10(max(p, 1e-8)) + 8) / 8 * LEVELS)))


def band(n: int) -> int:
    return max(i for i, least in enumerate(BANDS) if n >= least)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, by start and kind; failing matches are dropped."""
    low, found = text.lower(), []
    if any(h in low for h in ASSIGN_HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)])


def examine(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, str, int]], bytes]:
    """Base spans, candidates (start, end, band, encoding, level) that no base span meets, and the rest's pieces, glued."""
    base, candidates = base_spans(text), []
    for m in TOKEN.finditer(text):
        name = encoding(m[0])
        if name and not any(s < m.end() and m.start() < e for s, _, e in base):
            candidates.append((m.start(), m.end(), band(len(m[0])), name, level(randomness(m[0], name))))
    return base, candidates, glued(text, base)


def glued(text: str, base: list[tuple[int, int, int]]) -> bytes:
    """The short pieces outside of base spans. A text's hash says which glue comes first, so that short texts have them all between them."""
    at, rest = 0, []
    for s, _, e in base:
        rest.append(text[at : max(at, s)])
        at = max(at, e)
    pieces = PIECE.findall(" ".join([*rest, text[at:]]))
    turn = xxhash.xxh64_intdigest(text)
    glues = [GLUES[(turn + i) % len(GLUES)] for i in range(len(pieces) // STRETCH + 1)]
    return "".join(g.join(pieces[i * STRETCH : (i + 1) * STRETCH]) + g for i, g in enumerate(glues)).encode()


#: Classes of characters that alphabets hold or lack as a whole, the first in all of them that have digits.
_CLASSES = ("0189", "234567", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+/", "-_")
_NAMES = list(ALPHABETS)
_CLASS_OF = np.zeros(256, np.uint8)
for _i, _c in enumerate(_CLASSES):
    _CLASS_OF[list(_c.encode())] = 1 << _i
#: The encoding of a set of classes by number, -1 for digits alone, as encoding() has it.
_ENCODING_OF = np.array([_NAMES.index(n) if (n := encoding("".join(c for i, c in enumerate(_CLASSES) if mask >> i & 1))) else -1 for mask in range(256)])
_Z = np.arange(0, 26, 0.0005)
_LOG_TWO_SIDED = np.log(np.maximum([two_sided(z) for z in _Z.tolist()], 1e-300))


def _log_chi2_tail(x: np.ndarray, df: int) -> np.ndarray:
    half = x / 2
    return np.minimum(0.0, np.log(sum(half**i / math.factorial(i) for i in range(df // 2))) - half)


def levels_of(codes: np.ndarray, name: str) -> np.ndarray:
    """level(randomness()) of many tokens of one length and encoding, rows of character codes."""
    place = np.zeros(256, np.int16)
    place[list(ALPHABETS[name].encode())] = np.arange(len(ALPHABETS[name]))
    x, m, n = place[codes], len(ALPHABETS[name]), codes.shape[1]
    k = 5 if n < 32 else 9
    bins = np.arange(m) * k // m
    size = n * np.bincount(bins, minlength=k) / m
    seen = np.bincount((bins[x] + k * np.arange(len(x))[:, None]).ravel(), minlength=k * len(x)).reshape(-1, k)
    fisher = np.maximum(_log_chi2_tail(((seen - size) ** 2 / size).sum(axis=1), k - 1), math.log(1e-300))
    kind = np.array(_RUN_KINDS[name], np.int8)[x]
    each = np.stack([(kind == c).sum(axis=1) for c in range(4)]).astype(float)
    runs, squares, cubes = 1 + (kind[:, 1:] != kind[:, :-1]).sum(axis=1), (each**2).sum(axis=0), (each**3).sum(axis=0)
    mean = n + 1 - squares / n
    spread = (squares * (squares + n * (n + 1)) - 2 * n * cubes - n**3) / (n * n * (n - 1))
    z_runs = np.where(spread > 1e-9, (runs - mean) / np.sqrt(np.where(spread > 1e-9, spread, 1)), math.sqrt(n))
    off = x - x.mean(axis=1, keepdims=True)
    power = np.einsum("ij,ij->i", off, off)
    serial = np.where(power > 0, np.einsum("ij,ij->i", off[:, :-1], off[:, 1:]) / np.where(power > 0, power, 1), 1.0)
    for z in (z_runs, (serial + 1 / n) * math.sqrt(n)):
        fisher = fisher + np.interp(np.abs(z), _Z, _LOG_TWO_SIDED)
    log_p = np.maximum(_log_chi2_tail(-2 * fisher, 6) / math.log(10), -8)
    return np.clip(((log_p + 8) / 8 * LEVELS).astype(int), 0, LEVELS - 1)


def ordinary_counts(texts: list[bytes]) -> Counter[tuple[int, str, int]]:
    """How many tokens that glued texts are cut into have which (band, encoding, level); a rest shorter than a token is left."""
    found: Counter[tuple[int, str, int]] = Counter()
    for b, n in enumerate(BANDS):
        every = np.frombuffer(b"".join(t[: len(t) // n * n] for t in texts), np.uint8).reshape(-1, n)
        for at in range(0, len(every), ROWS):
            codes = every[at : at + ROWS]
            kind = _ENCODING_OF[np.bitwise_or.reduce(_CLASS_OF[codes], axis=1)]
            for e in set(kind.tolist()) - {-1}:
                for k, count in enumerate(np.bincount(levels_of(codes[kind == e], _NAMES[e])).tolist()):
                    if count:
                        found[b, _NAMES[e], k] += count
    return found


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def passing_levels(seen: list[tuple[int, str, int, int, int]], false_share: float = FALSE_SHARE) -> dict[tuple[int, str], int]:
    """The lowest passing level of each band and encoding. seen: (band, encoding, level, candidates, ordinary tokens).

    What passes by mistake is at most all candidates of the encoding by the rate of its ordinary
    tokens. An encoding with fewer than LEAST_ORDINARY of them is rare in ordinary text: then all
    candidates of the band by the rate at which its ordinary tokens have the encoding and pass, times
    the number of glues, as real tokens may all be held together by the one that suits the encoding.
    Where the band has fewer too, as in a table of a few short texts, nothing is measured and tokens
    pass at SMALL_P.
    """
    floor, out = level(LEAST_P), {}
    for b, e in {(b, e) for b, e, *_ in seen}:
        own = {k: (c, n) for b2, e2, k, c, n in seen if (b2, e2) == (b, e)}
        candidates, tokens = (sum(x) for x in zip(*own.values()))
        if tokens < LEAST_ORDINARY:
            candidates, tokens = (sum(x[i] for x in seen if x[0] == b) for i in (3, 4))
            candidates *= len(GLUES)
        if tokens < LEAST_ORDINARY:
            out[b, e] = level(SMALL_P)
            continue
        passed = ordinary = 0
        for k in range(LEVELS - 1, floor - 1, -1):
            passed += own.get(k, (0, 0))[0]
            ordinary += own.get(k, (0, 0))[1]
            if passed and candidates * (ordinary + 1) / (tokens + 1) <= false_share * passed:
                out[b, e] = k
    return out


def scan_secrets(docs: DataFrame, false_share: float = FALSE_SHARE) -> DataFrame:
    """Return doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random.

    spans has kind:start:end of base and random spans, in code points, by start and kind. A null
    text is empty and has none (the digest of no bytes); repeated rows get equal results; an empty
    table gives no rows.
    """
    span, candidate = "struct<start int, kind int, end int>", "struct<start int, end int, band int, encoding string, level int>"
    kinds = [pa.list_(pa.struct([(n, pa.string() if n == "encoding" else pa.int32()) for n in names])) for names in (("start", "kind", "end"), ("start", "end", "band", "encoding", "level"), ("band", "encoding", "level", "count"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list(examine(t.as_py())) for t in batch.column(1)]
            counts = [(*key, n) for key, n in ordinary_counts([row[2] for row in found]).items()]
            for i, row in enumerate(found):
                row[2] = [] if i else counts  # the batch's counts stand in its first row
            columns = [pa.array([[dict(zip((f.name for f in kind.value_type), x)) for x in row[k]] for row in found], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "base", "candidates", "ordinary"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", whole().alias("text"))
    rows = map_texts(rows, run, f"doc_id {kind}, base array<{span}>, candidates array<{candidate}>, ordinary array<struct<band int, encoding string, level int, count int>>")
    rows = checkpointed(rows)  # small; read twice
    both = F.concat(
        F.transform("candidates", lambda c: F.struct(c["band"].alias("b"), c["encoding"].alias("e"), c["level"].alias("k"), F.lit(1).alias("c"), F.lit(0).alias("n"))),
        F.transform("ordinary", lambda c: F.struct(c["band"].alias("b"), c["encoding"].alias("e"), c["level"].alias("k"), F.lit(0).alias("c"), c["count"].alias("n"))))
    counts = rows.select(F.explode(both).alias("x")).groupBy("x.b", "x.e", "x.k").agg(F.sum("x.c").alias("c"), F.sum("x.n").alias("n"))
    # bands x encodings x levels rows at most
    passing = passing_levels([tuple(r) for r in counts.collect()], false_share)
    passes = F.create_map(*[F.lit(x) for (b, e), k in passing.items() for x in (f"{b} {e}", k)]) if passing else F.lit(None).cast("map<string,int>")
    random = F.filter("candidates", lambda c: c["level"] >= F.coalesce(F.try_element_at(passes, F.concat_ws(" ", c["band"].cast("string"), c["encoding"])), F.lit(LEVELS)))
    added = F.transform(random, lambda c: F.struct(c["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), c["end"].alias("end")))
    count = lambda name: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(name))).cast("long").alias(f"n_{name}")
    return rows.select("doc_id", count("assign"), count("access"), count("hex"), sha256_of(_joined(F.col("base"))).alias("base_sha256"), _joined(F.sort_array(F.concat("base", added))).alias("spans"), F.size(added).cast("long").alias("n_random"))
