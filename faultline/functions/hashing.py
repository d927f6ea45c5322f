"""Fingerprint hashes, MinHash sketches, band keys and edit similarity.

Parts are framed by their length, so no choice of parts can imitate another. Fingerprints are 128 bits of
BLAKE3, whose public algorithm is computed for a whole batch at once, or of SHA-256 if that is asked for.
"""

from __future__ import annotations

from functools import reduce
from hashlib import blake2b, sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.functions.frames import TEST_GLOBS, parse_stack
from faultline.functions.normalize import VERSION, Normalizer, worker_normalizer
from faultline.functions.text import units
from faultline.session import written

SEP = "\x1f"
STRICT_FRAMES, LOOSE_FRAMES = 5, 3
PRIME31 = (1 << 31) - 1
PERMUTATIONS, BANDS, BAND_ROWS = 128, 32, 4
SHINGLE, LEAST_UNITS = 5, 40
#: Bits of a position that go with a key; the most keys that are split; bytes of text that are sketched together.
PLANES, MOST_CROWDED, _PIECE = 3, 100_000, 1 << 15
#: BLAKE3's public constants: the initial state and the message permutation; fixed values.
_IV = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], np.uint32)
_PERM = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
_CHUNK_START, _CHUNK_END, _PARENT, _ROOT = 1, 2, 4, 8


def framed(parts: Column) -> Column:
    """One string from an array of strings: each part behind its length in UTF-16 units. Null parts are empty."""
    one = lambda p: F.concat(units(F.coalesce(p, F.lit(""))).cast("string"), F.lit(SEP), F.coalesce(p, F.lit("")))
    return F.array_join(F.transform(parts, one), SEP)


def sha_128(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 32)


def _compress(cv: np.ndarray, block: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """One compression for many inputs: cv (n, 8), block (n, 16); the state's 16 words come back."""
    n = len(cv)
    v = np.empty((16, n), np.uint32)
    v[:8], v[8:12] = cv.T, _IV[:4, None]
    v[12], v[13] = counter.astype(np.uint32), (counter >> 32).astype(np.uint32)
    v[14], v[15] = length, flags
    m = block.T.copy()

    def turn(x: np.ndarray, r: int) -> np.ndarray:
        return (x >> np.uint32(r)) | (x << np.uint32(32 - r))

    def mix(a: int, b: int, c: int, d: int, x: np.ndarray, y: np.ndarray) -> None:
        for word, r1, r2 in ((x, 16, 12), (y, 8, 7)):
            v[a] += v[b] + word
            v[d] = turn(v[d] ^ v[a], r1)
            v[c] += v[d]
            v[b] = turn(v[b] ^ v[c], r2)

    for r in range(7):
        for i in range(4):
            mix(i, 4 + i, 8 + i, 12 + i, m[2 * i], m[2 * i + 1])
        for i in range(4):
            mix(i, 4 + (i + 1) % 4, 8 + (i + 2) % 4, 12 + (i + 3) % 4, m[8 + 2 * i], m[9 + 2 * i])
        m = m[_PERM] if r < 6 else m
    v[:8] ^= v[8:]
    v[8:] ^= cv.T
    return v.T


def blake3_128(data: list[bytes]) -> list[str]:
    """Hex of the first 16 bytes of BLAKE3 for each input; inputs of like block counts are hashed side by side."""
    out: list[str | None] = [None] * len(data)
    short: dict[int, list[int]] = {}
    for i, d in enumerate(data):
        if len(d) <= 1024:
            short.setdefault(max(1, -(-len(d) // 64)), []).append(i)
        else:
            out[i] = _long(d)
    for blocks, own in short.items():
        raw = np.zeros((len(own), blocks * 64), np.uint8)
        sizes = np.array([len(data[i]) for i in own], np.uint32)
        for j, i in enumerate(own):
            raw[j, : len(data[i])] = np.frombuffer(data[i], np.uint8)
        words = raw.view("<u4").reshape(len(own), blocks, 16)
        cv, zero = np.tile(_IV, (len(own), 1)), np.zeros(len(own), np.int64)
        for b in range(blocks):
            last = b == blocks - 1
            flag = (_CHUNK_START if b == 0 else 0) | (_CHUNK_END | _ROOT if last else 0)
            length = sizes - np.uint32(64 * b) if last else np.full(len(own), 64, np.uint32)
            state = _compress(cv, words[:, b], zero, length, np.full(len(own), flag, np.uint32))
            cv = state[:, :8]
        for j, i in enumerate(own):
            out[i] = np.ascontiguousarray(cv[j, :4]).astype("<u4").tobytes().hex()
    return out  # type: ignore[return-value]


def _long(d: bytes) -> str:
    """More than one chunk: chunks side by side, then the tree, whose left part is the largest power of two."""
    n = -(-len(d) // 1024)
    raw = np.zeros(n * 1024, np.uint8)
    raw[: len(d)] = np.frombuffer(d, np.uint8)
    words = raw.view("<u4").reshape(n, 16, 16)
    size = np.full(n, 1024, np.int64)
    size[-1] = len(d) - 1024 * (n - 1)
    last = np.maximum(1, -(-size // 64)) - 1
    cv, counter = np.tile(_IV, (n, 1)), np.arange(n, dtype=np.int64)
    for b in range(16):
        own = np.flatnonzero(last >= b)
        end = last[own] == b
        flag = np.where(b == 0, _CHUNK_START, 0) | np.where(end, _CHUNK_END, 0)
        length = np.where(end, size[own] - 64 * b, 64)
        cv[own] = _compress(cv[own], words[own, b], counter[own], length.astype(np.uint32), flag.astype(np.uint32))[:, :8]

    def parent(left: np.ndarray, right: np.ndarray, root: bool) -> np.ndarray:
        block = np.concatenate((left, right))[None]
        flags = np.array([_PARENT | (_ROOT if root else 0)], np.uint32)
        return _compress(_IV[None].copy(), block, np.zeros(1, np.int64), np.array([64], np.uint32), flags)[0, :8]

    def tree(lo: int, hi: int, root: bool) -> np.ndarray:
        if hi - lo == 1:
            return cv[lo]
        half = 1 << ((hi - lo - 1).bit_length() - 1)
        return parent(tree(lo, lo + half, False), tree(lo + half, hi, False), root)

    return tree(0, n, True)[:4].astype("<u4").tobytes().hex()


def blake3_column(text: Column | str) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        known = s.notna().to_numpy()
        out = np.full(len(s), None, object)
        out[known] = blake3_128([x.encode() for x in s[known]])
        return pd.Series(out)

    return run(text)


FINGERPRINT = T.StructType([
    T.StructField("fingerprint", T.StringType()), T.StructField("strict_hash", T.StringType()), T.StructField("loose_hash", T.StringType()), T.StructField("frame_fallback", T.BooleanType()),
])


def _framed(parts: list[str]) -> bytes:
    """The same framing as `framed`, for one list of parts."""
    out = []
    for p in parts:
        n = len(p) if p.isascii() else len(p.encode("utf-16-le", "surrogatepass")) // 2
        out += (str(n), p)
    return SEP.join(out).encode("utf-8", "surrogatepass")


def _hash(data: list[bytes], algorithm: str) -> list[str]:
    return blake3_128(data) if algorithm == "blake3" else [sha256(d).hexdigest()[:32] for d in data]


def fingerprint_column(error_type: Column | str, message: Column | str, stack: Column | str, algorithm: str = "blake3", disabled: tuple[str, ...] = (), repo_root: str | None = None, home_dir: str | None = None, test_globs: tuple[str, ...] = TEST_GLOBS, vendor_dirs: tuple[str, ...] = ()) -> Column:
    """struct(fingerprint, strict_hash, loose_hash, frame_fallback), one pass over a batch's rows.

    strict_hash: type, strict message, up to five frames with lines; loose_hash: type, loose message, up to three frames
    without. Frames are the application's; if a stack has none, all of its frames, and frame_fallback is true. The
    fingerprint is the strict hash behind its version. Null parts count as empty."""
    if algorithm not in ("blake3", "sha256"):
        raise ValueError("algorithm is blake3 or sha256")
    args = (tuple(disabled), repo_root, home_dir)
    Normalizer(*args)
    globs, vendor = tuple(test_globs), tuple(vendor_dirs)

    @F.pandas_udf(FINGERPRINT)
    def run(kind: pd.Series, text: pd.Series, trace: pd.Series) -> pd.DataFrame:
        norm = worker_normalizer(*args)
        strict, loose, fallback = [], [], []
        for k, t, x in zip(kind, text, trace):
            frames = parse_stack(x, globs, vendor) if x else []
            app = [f for f in frames if f[5] == "app"]
            head = norm.form(k or "", "strict")
            s, l_ = norm.forms(t or "")
            parts, short = [head, s], [head, l_]
            for i, (_, fn, file, line, _, _) in enumerate((app or frames)[:STRICT_FRAMES]):
                file = norm.form((file or "").replace("\\", "/"), "strict")
                fn = norm.form(fn or "", "strict")
                parts += (file, "" if line is None else str(line), fn)
                if i < LOOSE_FRAMES:
                    short += (file, fn)
            strict.append(_framed(parts))
            loose.append(_framed(short))
            fallback.append(bool(frames) and not app)
        s = _hash(strict, algorithm)
        return pd.DataFrame({"fingerprint": [f"fp_v{VERSION}_{x}" for x in s], "strict_hash": s, "loose_hash": _hash(loose, algorithm), "frame_fallback": fallback})

    return run(error_type, message, stack)


def with_fingerprint(df, error_type: str = "errorType", message: str = "message", stack: str = "stackText", **options):
    """Adds fingerprint, strict_hash, loose_hash and frame_fallback, in place of columns of these names."""
    f = df.withColumn("_fp", fingerprint_column(error_type, message, stack, **options))
    return f.withColumns({n: F.col("_fp")[n] for n in FINGERPRINT.names}).drop("_fp")


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    """128 pairs from a linear congruential generator with a fixed start."""
    state, a, b = 0x9E3779B9, [], []
    for _ in range(PERMUTATIONS):
        state = (state * 1664525 + 1013904223) % (1 << 32)
        a.append(state % (PRIME31 - 1) + 1)
        state = (state * 1664525 + 1013904223) % (1 << 32)
        b.append(state % PRIME31)
    return np.array(a, np.uint64), np.array(b, np.uint64)


_A, _B = _coefficients()


def _signatures(texts: list[str | None]) -> np.ndarray:
    """A row of 128 positions for each text; all PRIME31, which no sketch has, for null and for fewer than 40 UTF-16 units."""
    out = np.full((len(texts), PERMUTATIONS), PRIME31, np.uint32)
    own, piece, size = [], [], 0
    for i, t in enumerate(texts):
        raw = b"" if t is None else t.encode("utf-16-le", "surrogatepass")
        if len(raw) < 2 * LEAST_UNITS:
            continue
        own.append(i)
        piece.append(raw)
        size += len(raw)
        if size > _PIECE:
            out[own] = _sketched(piece)
            own, piece, size = [], [], 0
    if own:
        out[own] = _sketched(piece)
    return out


def _sketched(piece: list[bytes]) -> np.ndarray:
    """The sketches of encoded texts, side by side."""
    u = np.frombuffer(b"".join(piece), np.uint16).astype(np.uint64)
    units_ = np.array([len(x) // 2 for x in piece])
    mask, prime = np.uint64(0xFFFFFFFF), np.uint64(16777619)
    h = np.full(len(u) - SHINGLE + 1, 0x811C9DC5, np.uint64)
    for i in range(SHINGLE):
        c = u[i : i + len(h)]
        h = ((h ^ (c & np.uint64(0xFF))) * prime) & mask
        wide = c > np.uint64(0xFF)
        if wide.any():
            h = np.where(wide, ((h ^ (c >> np.uint64(8))) * prime) & mask, h)
    ends, windows = np.cumsum(units_), units_ - SHINGLE + 1
    inside = np.ones(len(u), bool)
    for i in range(1, SHINGLE):  # windows that begin here run into the next text
        inside[ends - i] = False
    p31, bits = np.uint64(PRIME31), np.uint64(31)
    h, starts = h[inside[: len(h)]] % p31, np.cumsum(windows) - windows
    if len(piece) == 1:  # it may be long
        h = np.unique(h)
    out = np.empty((len(piece), PERMUTATIONS), np.uint32)
    for k in range(PERMUTATIONS):
        x = h * _A[k] + _B[k]
        x = (x & p31) + (x >> bits)  # the remainder by 2^31 - 1, or that and once the prime
        out[:, k] = np.minimum.reduceat(np.minimum(x, x - p31), starts)
    return out


def _listed(sigs: np.ndarray) -> list[list[int] | None]:
    return [None if x[0] == PRIME31 else x for x in sigs.tolist()]


def minhash_signature(text: str | None) -> list[int] | None:
    """None for null and for texts of fewer than 40 UTF-16 units."""
    return _listed(_signatures([text]))[0]


def minhash(text: Column | str) -> Column:
    @F.pandas_udf("array<int>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(_listed(_signatures(s.tolist())), index=s.index, dtype=object)

    return run(text)


def estimate_jaccard(a: Column, b: Column) -> Column:
    """Share of equal positions; signatures of different lengths are an error."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("signatures differ in length")).cast("double")).otherwise(same / F.size(a))


def band_keys(signature: Column | str) -> Column:
    """32 keys `band:hash` over four positions each."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else _bands(np.asarray(x, np.uint64)))

    return run(signature)


def _bands(sig: np.ndarray) -> list[str]:
    return [f"{i}:{np.base_repr(int(x), 36).lower()}" for i, x in enumerate(_blocks(sig[None], BANDS)[0])]


def _blocks(sigs: np.ndarray, n: int) -> np.ndarray:
    """32-bit hashes of n runs of positions, as even as can be, for each sketch; those of 32 runs are the bands'."""
    cuts = np.arange(n + 1) * PERMUTATIONS // n
    sigs, h = sigs.astype(np.uint64), np.tile(np.uint64(0x811C9DC5) ^ np.arange(n, dtype=np.uint64), (len(sigs), 1))
    for r in range(-(-PERMUTATIONS // n)):
        own = np.flatnonzero(cuts[:-1] + r < cuts[1:])
        x, g = sigs[:, cuts[own] + r], h[:, own]
        for shift in (0, 8, 16, 24):
            g = ((g ^ ((x >> np.uint64(shift)) & np.uint64(0xFF))) * np.uint64(16777619)) & np.uint64(0xFFFFFFFF)
        h[:, own] = g
    return h


def _planes(sigs: np.ndarray) -> np.ndarray:
    """PLANES bits of a hash of each position, by bit: two longs for each. Positions that are equal have equal bits."""
    mixed = (sigs.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(32 - PLANES)
    return np.concatenate([np.packbits((mixed >> np.uint32(k)) & np.uint32(1), axis=1).view(np.int64) for k in range(PLANES)], axis=1)


def _compact(signature: Column | str, blocks: int) -> Column:
    """struct(digest, keys, bits) of a sketch: its hash, those of its blocks and a few bits of each position."""

    @F.pandas_udf("digest binary, keys array<int>, bits array<bigint>")
    def run(s: pd.Series) -> pd.DataFrame:
        own = np.flatnonzero(s.notna().to_numpy())
        digest, keys, bits = (np.full(len(s), None, object) for _ in range(3))
        if len(own):
            sigs = np.stack(s.iloc[own].tolist()).astype(np.uint32)
            for i, x, k, p in zip(own, sigs, _blocks(sigs, blocks).astype(np.uint32).view(np.int32), _planes(sigs)):
                digest[i], keys[i], bits[i] = blake2b(x.tobytes(), digest_size=16).digest(), k, p
        return pd.DataFrame({"digest": digest, "keys": keys, "bits": bits})

    return run(signature)


def _same_positions(a: Column, b: Column) -> Column:
    """Share of equal positions of two texts' sketches; a text is sketched once a batch."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        known: dict[str, int] = {}
        i, j = (np.array([known.setdefault(t, len(known)) for t in s], np.int64) for s in (x, y))
        sigs = _signatures(list(known))
        return pd.Series((sigs[i] == sigs[j]).mean(axis=1))

    return run.asNondeterministic()(a, b)  # else a filter on it runs it once more


def lsh_candidates(df, id: str, signature: str, least: float = 0.0, members: bool = False, crowd: int = 2000, text: str | None = None):
    """Pairs (a < b) that share a band key, with the estimated similarity, from `least` on.

    Equal signatures are one representative each; a pair found under several keys is kept once. With `members`, the
    pairs are those of all ids: what stands behind one signature is paired too, with similarity 1. `text`: the column
    whose `minhash` the signature is, if that is shorter; it goes with the pairs in place of the signature.

    Where `least` leaves a pair at most 31 unequal positions, it has an equal band, and an equal one among any blocks
    that are one more than those positions; so fewer and longer blocks are the keys there and find the same pairs. A
    key carries some bits of each position, which rule out most pairs where they meet, and none that reaches `least`."""
    differ = PERMUTATIONS - next((n for n in range(PERMUTATIONS + 1) if n / PERMUTATIONS >= least), PERMUTATIONS + 1)
    blocks = max(1, differ + 1) if differ < BANDS else BANDS
    # nothing is filtered or taken apart before it is written, or Python would run for each
    rows = written(df.select(F.col(id).alias("id"), _compact(F.col(signature), blocks).alias("c"))).where("c.digest is not null").select("id", "c.*")
    # keys and bits follow from the digest
    reps = written(rows.groupBy("digest", "keys", "bits").agg(F.min("id").alias("rep")))
    key = lambda pos, h: F.shiftleft(pos.cast("long"), 32).bitwiseOR(h.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    keys = reps.select("rep", "bits", F.posexplode("keys").alias("pos", "h")).select("rep", "bits", key(F.col("pos"), F.col("h")).alias("k"))
    # the sketches of a crowded key are dealt out over cells of two blocks, so none is paired in one task; at most MOST_CROWDED keys are
    crowd = max(crowd, reps.count() * blocks // MOST_CROWDED)
    often = written(keys.groupBy("k").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > crowd).select("k", F.ceil(F.col("c") / crowd).cast("int").alias("nb")))
    dealt = keys.join(F.broadcast(often), "k", "left").withColumn("nb", F.coalesce("nb", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).withColumns({"x": F.least("block", "o"), "y": F.greatest("block", "o")})
    words = [F.col("bits")[i].alias(f"w{i}") for i in range(2 * PLANES)]
    dealt = dealt.select("k", F.shiftleft(F.col("x").cast("long"), 32).bitwiseOR(F.col("y").cast("long")).alias("cell"), F.when(F.col("x") == F.col("y"), -1).otherwise(F.col("block")).alias("block"), "rep", *words)
    # two of one block meet in their own cell only
    p, q = dealt.alias("p"), dealt.alias("q")
    unlike = lambda i: reduce(Column.bitwiseOR, (F.col(f"p.w{2 * k + i}").bitwiseXOR(F.col(f"q.w{2 * k + i}")) for k in range(PLANES)))
    met = (F.col("p.rep") < F.col("q.rep")) & ((F.col("p.block") == -1) | (F.col("p.block") != F.col("q.block")))
    met &= F.bit_count(unlike(0)) + F.bit_count(unlike(1)) <= differ
    pairs = p.join(q, (F.col("p.k") == F.col("q.k")) & (F.col("p.cell") == F.col("q.cell")) & met).select(F.col("p.rep").alias("a"), F.col("q.rep").alias("b"))
    pairs = pairs.repartition("a").dropDuplicates(["a", "b"])  # so it lies as the next join needs it
    whole = lambda n, x: df.select(F.col(id).alias(n), F.col(text or signature).alias(x))
    j = pairs.join(whole("a", "sa"), "a").join(whole("b", "sb"), "b")
    out = j.select("a", "b", (estimate_jaccard if text is None else _same_positions)(F.col("sa"), F.col("sb")).alias("similarity")).where(F.col("similarity") >= least)
    if not members:
        return out
    m = rows.select("digest", F.col("id").alias("m")).join(reps.select("digest", "rep"), "digest").select("rep", "m")
    x, y = m.select(F.col("rep").alias("a"), F.col("m").alias("ma")), m.select(F.col("rep").alias("b"), F.col("m").alias("mb"))
    between = out.join(x, "a").join(y, "b").select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b"), "similarity")
    within = x.join(y, F.col("a") == F.col("b")).where("ma < mb").select(F.col("ma").alias("a"), F.col("mb").alias("b"), F.lit(1.0).alias("similarity"))
    return between.unionAll(within) if least <= 1 else between


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 if equal, 0 if one is empty, else 1 - distance / longer length over the first 512 characters."""
    x, y = F.substring(a, 1, 512), F.substring(b, 1, 512)
    longer = F.greatest(F.length(x), F.length(y))
    return F.when(a == b, 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(1 - F.levenshtein(x, y) / longer)
