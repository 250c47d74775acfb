"""Plain versions, in one process and without Spark, of what the operators compute."""

import math
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np

from slopeworks.llm import classifier, rules, toxicity


def open_to_learning(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 != 1


def words_of(text):
    return [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]


def text_counts(text):
    words, text = words_of(text), text or ""
    lines = [x for x in text.split("\n") if words_of(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {k for i, w in enumerate(windows) if often[w] > 1 for k in range(i, i + 8)}
    n, chars, symbols, dup, repeat = len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)
    return {
        "n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat, "base_failed": n < 20 or 100 * repeat > 30 * n,
        "symbols": 1000 * symbols // max(chars, 1), "repeats": 1000 * repeat // max(n, 1), "lines": 1000 * dup // max(len(lines), 1),
    }


def most_rejected(n, alpha, delta):
    """The largest k with P(X <= k) <= delta, X ~ Bin(n, alpha), exactly; -1 if none."""
    a, total, k = Fraction(alpha).limit_denominator(10**6), Fraction(0), -1
    while k < n:
        total += math.comb(n, k + 1) * a ** (k + 1) * (1 - a) ** (n - k - 1)
        if total > Fraction(delta).limit_denominator(10**9):
            return k
        k += 1
    return k


def rules_verdict(docs, quality):
    """{doc_id: (counts, kept)} of (doc_id, text, lang) rows with unique ids and {doc_id: label}."""
    counted = {d: text_counts(t) for d, t, _ in docs}
    good = defaultdict(list)
    for d, _, lang in docs:
        if quality.get(d) == 1 and open_to_learning(d) and not counted[d]["base_failed"]:
            good[lang].append(d)
    per_rule, n_rules = rules.ALPHA / len(rules.RULES), len(rules.RULES)
    thin = {s for s, own in good.items() if most_rejected(len(own), per_rule, rules.DELTA / (len(good) * n_rules)) < 0}
    groups = defaultdict(list)
    for s, own in good.items():
        groups["thin" if s in thin else ("own", s)] += own
    cut = {}
    for g, own in groups.items():
        allowed = most_rejected(len(own), per_rule, rules.DELTA / (len(groups) * n_rules))
        for rule, least in rules.RULES.items():
            values = sorted(counted[d][rule] for d in own)
            safe = [q for q in values if sum(v > q for v in values) <= allowed]
            if safe:
                cut[g, rule] = max(min(safe), least)
    out = {}
    for d, _, lang in docs:
        g = "thin" if lang in thin else ("own", lang)
        over = any(counted[d][rule] > cut.get((g, rule), math.inf) for rule in rules.RULES)
        out[d] = (counted[d], not counted[d]["base_failed"] and not over)
    return out


def quality_scores(docs, quality, calibrates):
    """{doc_id: score}: one direct ridge solve over all rows at once, then pooled bins."""
    x = np.array([classifier.statistics((t or "").encode()) for _, t, *_ in docs])
    project = classifier.Projection(x.mean(axis=0), x.std(axis=0))
    z = project(x)
    open_ = [k for k, (d, *_) in enumerate(docs) if d in quality and open_to_learning(d)]
    fit, hold = [k for k in open_ if docs[k][0] not in calibrates], [k for k in open_ if docs[k][0] in calibrates]
    y = np.array([quality.get(d, 0) for d, *_ in docs], float)
    # Ridge as least squares with one more row per feature.
    wide = np.vstack([z[fit], np.diag(np.sqrt([1e-9] + [classifier.PENALTY * len(fit)] * classifier.FEATURES))])
    weights = np.linalg.lstsq(wide, np.concatenate([y[fit], np.zeros(classifier.FEATURES + 1)]), rcond=None)[0]
    raw = z @ weights
    bins = classifier.bin_of(raw)
    blocks = [[[b], float(sum(y[k] for k in hold if bins[k] == b)), sum(bins[k] == b for k in hold)] for b in sorted({bins[k] for k in hold})]
    while True:
        bad = next((i for i in range(len(blocks) - 1) if blocks[i][1] / blocks[i][2] >= blocks[i + 1][1] / blocks[i + 1][2]), None)
        if bad is None:
            break
        blocks[bad : bad + 2] = [[blocks[bad][0] + blocks[bad + 1][0], blocks[bad][1] + blocks[bad + 1][1], blocks[bad][2] + blocks[bad + 1][2]]]
    return {d: (raw[k], bins[k], blocks) for k, (d, *_) in enumerate(docs)}


def quality_score(found):
    raw, at, blocks = found
    # An empty bin takes the rate of the block to its left; before the first block, that of the first.
    own = [b for b in blocks if min(b[0]) <= at] or blocks[:1]
    rate = own[-1][1] / own[-1][2] if blocks else 0.5
    return 0.98 * rate + 0.02 / (1 + math.exp(-4 * (raw - 0.5)))


def subwords(word):
    """Buckets of one word (bytes), by loops over its characters."""
    marked = "<" + word.decode() + ">"
    buckets = [toxicity.BUCKETS + zlib.crc32(word) % toxicity.BUCKETS]
    for size in toxicity.NGRAMS:
        for at in range(len(marked) - size + 1):
            key = size
            for c in marked[at : at + size]:
                key = ((key ^ ord(c)) * 0x9E3779B97F4A7C15) & (1 << 64) - 1
            buckets.append(key >> 64 - (toxicity.BUCKETS.bit_length() - 1))
    return buckets


def toxicity_score(text, model):
    """Mean of the subwords' values, by loops."""
    total, n = 0.0, 0
    for word in toxicity.words_of((text or "").encode()):
        buckets = subwords(word)
        total += sum(float(model.value[b]) for b in buckets)
        n += len(buckets)
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, model.offset + model.scale * total / max(n, 1)))))


def toxicity_training(texts, labels):
    """(value of every bucket seen, raw scores and labels of the texts kept apart): the training of `toxicity.train`, number by number."""
    bags = [Counter(b for w in toxicity.words_of(t) for b in subwords(w)) for t in texts]
    held = Counter(b for bag in bags for b in bag)
    known = [{b: n / sum(bag.values()) for b, n in bag.items() if held[b] >= toxicity.LEAST_TEXTS} for bag in bags]
    rng = np.random.default_rng(toxicity.SEED)
    order = rng.permutation(len(bags)).tolist()
    apart, learn = order[: len(bags) // 5], [k for k in order[len(bags) // 5 :] if known[k]]
    drawn = rng.uniform(-1e-3, 1e-3, (2 * toxicity.BUCKETS, toxicity.DIM))
    vector = {b: drawn[b].tolist() for b, n in held.items() if n >= toxicity.LEAST_TEXTS}
    seen = dict.fromkeys(vector, 1e-6)
    softmax = rng.normal(0, 0.5, (toxicity.DIM, 2)).tolist()
    seen_s, bias = [[1e-6] * 2 for _ in softmax], [0.0, 0.0]
    batches = [learn[k : k + toxicity.BATCH] for k in range(0, len(learn), toxicity.BATCH)]
    epochs, dims = max(toxicity.EPOCHS, -(-toxicity.STEPS // len(batches))), range(toxicity.DIM)
    for epoch in range(epochs):
        rate = toxicity.RATE * (1 - epoch / epochs)
        for which in rng.permutation(len(batches)):
            batch = batches[which]
            grad_s, grad_b, grad_v = [[0.0] * 2 for _ in dims], [0.0] * 2, {}
            for k in batch:
                mean = [toxicity.GAIN * sum(w * vector[b][d] for b, w in known[k].items()) for d in dims]
                z = [sum(mean[d] * softmax[d][c] for d in dims) + bias[c] for c in (0, 1)]
                top = [math.exp(x - max(z)) for x in z]
                p = [x / sum(top) - (c == labels[k]) for c, x in enumerate(top)]
                for c in (0, 1):
                    grad_b[c] += p[c] / len(batch)
                    for d in dims:
                        grad_s[d][c] += mean[d] * p[c] / len(batch)
                for b, w in known[k].items():
                    own = grad_v.setdefault(b, [0.0] * toxicity.DIM)
                    for d in dims:
                        own[d] += w * sum(p[c] * softmax[d][c] for c in (0, 1))
            for c in (0, 1):
                bias[c] -= rate * grad_b[c]
                for d in dims:
                    seen_s[d][c] += grad_s[d][c] ** 2
                    softmax[d][c] -= rate * grad_s[d][c] / math.sqrt(seen_s[d][c])
            for b, own in grad_v.items():
                seen[b] += sum(x * x for x in own) / toxicity.DIM
                vector[b] = [v - rate * x / math.sqrt(seen[b]) for v, x in zip(vector[b], own, strict=True)]
    value = {b: toxicity.GAIN * sum(v[d] * (softmax[d][1] - softmax[d][0]) for d in dims) for b, v in vector.items()}
    raw = [sum(w * value[b] for b, w in known[k].items()) + bias[1] - bias[0] for k in apart]
    return value, raw, [labels[k] for k in apart], bias[1] - bias[0]
