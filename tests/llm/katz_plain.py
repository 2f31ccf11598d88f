"""The language model once more in plain Python, from texts to scores."""

import math
import zlib
from collections import Counter, defaultdict

CUT = 5


def discount(counts):
    n = Counter(counts)
    ratio = {}
    if all(n[r] for r in range(1, CUT + 2)):
        large = (CUT + 1) * n[CUT + 1] / n[1]
        ratio = {r: ((r + 1) * n[r + 1] / (r * n[r]) - large) / (1 - large) for r in range(1, CUT + 1)} if large != 1 else {}
    if not ratio or not all(0 < x < 1 for x in ratio.values()):
        lost = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        ratio = {r: 1 - lost / r for r in range(1, CUT + 1)}
    return lambda r: r * ratio[r] if r <= CUT else r - CUT * (1 - ratio[CUT])


def scores(rows):
    """{position: (held_out, n_tokens, n_known, train_tokens, base, score)} of (doc_id, text) rows."""
    texts = []
    for doc_id, text in rows:
        held = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1
        texts.append((held, [*(text or "").encode().lower().split(), "end"]))
    one, two = Counter(), defaultdict(Counter)
    for held, words in texts:
        if not held:
            one.update(words)
            for h, w in zip(["start", *words], words):
                two[h][w] += 1
    total = sum(one.values())
    keep1, keep2 = discount(one.values()), discount(c for row in two.values() for c in row.values())
    chance = {w: keep1(c) / total for w, c in one.items()}
    unknown = 1 - sum(chance.values()) if total else 1.0
    weight = {}
    for h, row in two.items():
        freed = 1 - sum(map(keep2, row.values())) / sum(row.values())
        weight[h] = freed / (1 - sum(chance[w] for w in row))

    def probability(h, w):
        if h in two and w in two[h]:
            return keep2(two[h][w]) / sum(two[h].values())
        return weight.get(h, 1.0) * chance.get(w, unknown)

    out = []
    for held, words in texts:
        base = sum(math.log10((one[w] + 0.5) / (total + 0.5 * (len(one) + 1))) for w in words)
        score = sum(math.log10(probability(h, w)) for h, w in zip(["start", *words], words))
        out.append((held, len(words), sum(one[w] > 0 for w in words), total, base, score))
    return out, probability, set(one)
