"""Plain reference computations that the tests hold the operators against."""

import hashlib
import math
import re
import zlib

import xxhash
import zstandard

from riskloom.llm import compression_toxicity as C

SMALL = "/root/testdata/sf0.001"


def without_repeats(rows, length):
    """(id, text) rows -> per row (bytes, 1 for each byte that goes)."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        i = float("inf") if i is None else i
        for s in range(len(b) - length + 1):
            w = b[s:s + length]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        i = float("inf") if i is None else i
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if first[b[s:s + length]] < i:
                gone[s:s + length] = b"\1" * length
        out.append((b, bytes(gone)))
    return out


def kept_bytes(raw, gone):
    return bytes(x for x, g in zip(raw, gone) if not g)


def repeats(rows, length):
    """(id, text) rows -> per row (n_bytes, n_removed, n_spans, sha256)."""
    return [(len(b), sum(gone), len(re.findall(b"\1+", gone)), hashlib.sha256(kept_bytes(b, gone)).hexdigest())
            for b, gone in without_repeats(rows, length)]


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def contamination(docs, items, window=13):
    """docs, items: (id, text) rows -> per document (n_words, n_hit, n_items, items_sha256, contaminated)."""
    runs = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            runs.setdefault(tuple(w[k:k + n]), set()).add(i)
    sizes = {len(r) for r in runs}
    out = []
    for _, t in docs:
        w = words(t)
        hit, names = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                found = runs.get(tuple(w[k:k + n]))
                if found:
                    hit.update(range(k, k + n))
                    names |= found
        s = ",".join(sorted(str(x) for x in names if x is not None))
        out.append((len(w), len(hit), len([x for x in names if x is not None]), hashlib.sha256(s.encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(w)))
    return out


def simhash(text, n=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    sh = [" ".join(w[i:i + n]) for i in range(max(1, len(w) - n + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(keys, linked):
    """Smallest reachable key of each position; ``linked(i, j)`` over all pairs."""
    root = list(range(len(keys)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    low = {}
    for i, k in enumerate(keys):
        if k is not None:
            low[find(i)] = min(low.get(find(i), k), k)
    return [low.get(find(i)) for i in range(len(keys))]


def toxicity(text, model):
    """A text's score under a fitted model, window by window, a new compressor for each."""
    def length(raw, window):
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(level=C.LEVEL, dict_data=d, write_content_size=False, write_dict_id=False).compress(window))

    ws = C.windows(text)
    plain = [length(model.ordinary, w) for w in ws]
    row = [1.0, math.log1p(len(ws)) / 4]
    mean = 0.0
    for other in (model.stems, model.toxic):
        saved = [p - length(other, w) for p, w in zip(plain, ws)]
        row += [math.log1p(sum(x >= k for x in saved)) for k in C.THRESHOLDS]
        row.append(math.log1p(1000 * sum(max(x, 0) for x in saved) / max(len(ws), 1) / C.WINDOW) / 3)
        mean = sum(saved) / max(len(ws), 1)
    row.append(mean)
    return 1 / (1 + math.exp(-min(30, max(-30, sum(a * b for a, b in zip(row, model.weights))))))


def token_ids(texts, path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    return [tok.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
