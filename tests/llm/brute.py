"""Plain versions of the operators, for small inputs."""

import hashlib
from collections import Counter

import numpy as np
import xxhash


def repeats(texts, size):
    """A boolean mask of removed bytes for each text."""
    seen = Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
    out = []
    for t in texts:
        m = np.zeros(len(t), bool)
        for i in range(len(t) - size + 1):
            if seen[t[i : i + size]] > 1:
                m[i : i + size] = True
        out.append(m)
    return out


def digest(text, mask):
    inside = np.concatenate([[False], mask, [False]])
    kept = bytes(np.frombuffer(text, np.uint8)[~mask])
    return len(text), int(mask.sum()), int((inside[1:] != inside[:-1]).sum()) // 2, hashlib.sha256(kept).hexdigest()


def fingerprint(text):
    words = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def word_fingerprint(text, size):
    words = [xxhash.xxh64_intdigest(w, 42) for w in bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()]
    hashes, mask = [], (1 << 64) - 1
    for i in range(max(1, len(words) - size + 1) if words else 0):
        h = 0
        for w in words[i : i + size]:
            h = (h * 0x9E3779B97F4A7C15 + w) & mask
        h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 & mask
        hashes.append(h ^ h >> 29)
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(values, budget=3):
    """The least index that each value reaches over links of few differing bits."""
    root = list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(values):
            for j, b in enumerate(values):
                if (a ^ b).bit_count() <= budget and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    return root
