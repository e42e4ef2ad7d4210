"""Plain-Python versions that the tests of several operators share."""

import hashlib
import math

SYLLABLES = ["ka", "lo", "mi", "ru", "te", "shan", "vor", "bel", "nu", "pri"]


def good_text(rng, seed, n=None):
    words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n or rng.randint(40, 90))]
    return " ".join([f"Start{seed}", *words]) + "."


def junk_text(rng):
    return "!! ".join("".join(rng.choice(SYLLABLES) for _ in range(3)).upper() for _ in range(5)) * 6


def brute_count(doc_id, mean, seed=10):
    u = (int(hashlib.md5(f"{seed}:{doc_id}:1".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    p = cdf = math.exp(-mean)
    k = 0
    while cdf < u:
        k += 1
        p *= mean / k
        cdf += p
    return k


def brute_lines(rows):
    first, out = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        lines = (t or "").split("\n")
        live = [(k, x.strip(" \t\r")) for k, x in enumerate(lines) if x.strip(" \t\r")]
        found = [(live[k][0], 3, "\n".join(x for _, x in live[k : k + 3]), [j for j, _ in live[k : k + 3]]) for k in range(len(live) - 2)]
        found += [(k, 1, x, [k]) for k, x in live if len(x.split()) >= 50]
        gone = set()
        for at, n, body, places in sorted(found, key=lambda f: f[:2]):
            if first.setdefault(body, (i, at, n)) != (i, at, n):
                gone |= set(places)
        out[i] = None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out

