"""The label model, the scorer and the signs of quality, held against plain loops; no Spark."""

import math
import random
import re
from collections import Counter

import numpy as np

from veilmark.llm.quality import LIMITS, SIGNS, patterns, text_signs
from veilmark.llm.toxicity import ADDRESS, LEXICONS, VOTERS, Voters, loudness, text_features
from veilmark.llm.weaklabel import LabelModel, LinearScorer, parts, train_scorer


def plain_em(rows, gold, m, first_hit, prior, steadiness, absence, rounds):
    """The same estimates by loops over documents and voters; (hit, prior, discount)."""
    hit, p1, discount, start = [[first_hit[0]] * m, [first_hit[1]] * m], prior, [1.0] * m, prior
    total = max(1.0, len(rows))

    def posterior(v):
        z = math.log(p1 / (1 - p1))
        for j in range(m):
            z += discount[j] * math.log(hit[1][j] / hit[0][j]) if v[j] else absence * discount[j] * math.log((1 - hit[1][j]) / (1 - hit[0][j]))
        return 1 / (1 + math.exp(-max(-30, min(30, z))))

    for turn in range(rounds):
        mass = [(v, 1 - p, p) for v in rows for p in [posterior(v)]] + [(v, *((w, 0.0) if c == 0 else (0.0, w))) for v, c, w in gold]
        held = [steadiness * total * (1 - start), steadiness * total * start]
        sums = [sum(x[1 + c] for x in mass) for c in (0, 1)]
        for c in (0, 1):
            for j in range(m):
                fired = sum(x[1 + c] for x in mass if x[0][j]) + held[c] * first_hit[c]
                hit[c][j] = min(1 - 1e-4, max(1e-4, fired / max(sums[c] + held[c], 1e-9)))
        hit[1] = [min(1 - 1e-4, max(a, b * 1.01)) for a, b in zip(hit[1], hit[0])]
        p1 = min(0.5, max(1e-3, (sums[1] + held[1]) / (sum(sums) + sum(held))))
        if turn in (rounds // 3, 2 * rounds // 3):
            rho = [[0.0] * m for _ in range(m)]
            for c in (0, 1):
                whole = max(sums[c], 1e-9)
                mean = [sum(x[1 + c] * x[0][j] for x in mass) / whole for j in range(m)]
                cov = [[sum(x[1 + c] * (x[0][j] - mean[j]) * (x[0][k] - mean[k]) for x in mass) / whole for k in range(m)] for j in range(m)]
                sd = [math.sqrt(max(cov[j][j], 1e-6)) for j in range(m)]
                for j in range(m):
                    for k in range(m):
                        rho[j][k] += cov[j][k] / (sd[j] * sd[k]) / 2
            discount = [1 / (1 + sum(max(rho[j][k], 0) for k in range(m) if k != j)) for j in range(m)]
    return hit, p1, discount, posterior


def draw_votes(n, hit, prior, seed):
    rng = np.random.default_rng(seed)
    label = rng.random(n) < prior
    return (rng.random((n, len(hit[0]))) < np.where(label[:, None], hit[1], hit[0])).astype(int), label


def test_label_model_is_the_plain_one():
    votes, label = draw_votes(300, ([0.02, 0.05, 0.1, 0.02], [0.7, 0.5, 0.6, 0.3]), 0.2, 1)
    votes[:, 3] = votes[:, 0] | votes[:, 3]  # one voter follows another
    gold = [(tuple(v), int(c), w) for v, c, w in zip(votes[:40], label[:40], np.linspace(0.5, 2, 40))]
    packed = votes @ (1 << np.arange(4))
    every = np.arange(16)
    counts = np.bincount(packed, minlength=16).astype(float)
    known = np.zeros((16, 2))
    for v, c, w in gold:
        known[sum(x << j for j, x in enumerate(v)), c] += w
    for absence in (1.0, 0.25):
        model = LabelModel(list("abcd"), absence=absence).fit(every, counts, known, first_hit=(0.01, 0.4), prior=0.1, steadiness=0.05, rounds=12)
        hit, prior, discount, posterior = plain_em([tuple(v) for v in votes], gold, 4, (0.01, 0.4), 0.1, 0.05, absence, 12)
        assert np.allclose(model.hit, hit) and np.isclose(model.prior, prior) and np.allclose(model.discount, discount)
        assert np.allclose(model.posterior(every), [posterior([p >> j & 1 for j in range(4)]) for p in range(16)])
        assert model.discount[0] < model.discount[1]  # what follows another counts for less


def test_planted_accuracies_are_found():
    hit = ([0.01, 0.03, 0.05, 0.02, 0.08], [0.6, 0.7, 0.5, 0.4, 0.8])
    votes, label = draw_votes(40_000, hit, 0.15, 2)
    counts = np.bincount(votes @ (1 << np.arange(5)), minlength=32).astype(float)
    model = LabelModel(list("abcde")).fit(np.arange(32), counts, first_hit=(0.02, 0.5), prior=0.1, steadiness=0.01, rounds=200)
    assert np.abs(model.hit - np.array(hit)).max() < 0.06 and abs(model.prior - 0.15) < 0.03
    told = model.posterior(votes @ (1 << np.arange(5))) > 0.5
    assert (told == label).mean() > 0.95


def plain_scorer(docs, target, importance, screen, lasso, least, rounds):
    """(weights by feature, bias) by loops."""
    whole = sum(importance)
    imp = [x / whole for x in importance]
    share = sum(i * t for i, t in zip(imp, target))
    seen, mass, pull = Counter(), Counter(), Counter()
    for d, i, t in zip(docs, imp, target):
        for f in d:
            seen[f] += 1
            mass[f] += i
            pull[f] += i * (t - share)
    names = sorted(f for f in seen if seen[f] >= least and abs(pull[f]) / math.sqrt(max(mass[f], 1e-9)) >= screen)
    w, gw, bias, gb = dict.fromkeys(names, 0.0), dict.fromkeys(names, 1e-4), math.log((share + 1e-3) / (1 - share + 1e-3)), 1e-4
    for turn in range(rounds):
        slip = [i * (1 / (1 + math.exp(-max(-35, min(35, bias + sum(w.get(f, 0.0) for f in d))))) - t) for d, i, t in zip(docs, imp, target)]
        step = 0.3 / (1 + turn / 12)
        for f in names:
            grad = sum(s for d, s in zip(docs, slip) if f in d) / math.sqrt(max(mass[f], 1e-9))
            gw[f] = 0.9 * gw[f] + 0.1 * grad * grad
            rate = step / (math.sqrt(gw[f]) + 1e-3)
            moved = w[f] - rate * grad
            w[f] = math.copysign(max(abs(moved) - rate * lasso, 0), moved)
        gb = 0.9 * gb + 0.1 * sum(slip) ** 2
        bias -= step * sum(slip) / (math.sqrt(gb) + 1e-3)
    return w, bias


def test_scorer_is_the_plain_one(monkeypatch):
    draw = random.Random(4)
    docs = [sorted({draw.randrange(30) for _ in range(draw.randint(0, 9))} | ({31} if n % 3 == 0 else set())) for n in range(90)]
    target = [0.9 if 31 in d else 0.1 for d in docs]
    importance = [draw.uniform(0.5, 2) for _ in docs]
    indices, offsets = np.array([f for d in docs for f in d]), np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    got = train_scorer(indices, offsets, np.array(target), np.array(importance), 40, screen=0.02, rounds=60)
    weights, bias = plain_scorer(docs, target, importance, 0.02, 0.001, 3, 60)
    assert np.isclose(got.bias, bias) and np.allclose(got.weights, [weights.get(f, 0.0) for f in range(40)])
    scores = got.scores(indices, offsets)
    assert np.allclose(scores, [1 / (1 + math.exp(-(got.bias + sum(got.weights[f] for f in d)))) for d in docs])
    assert min(s for s, d in zip(scores, docs) if 31 in d) > max(s for s, d in zip(scores, docs) if 31 not in d)
    assert [x for a, b in parts(offsets, 20) for x in range(a, b)] == list(range(len(docs)))
    assert LinearScorer(4, np.zeros(4), -20.0).scores(np.zeros(0, int), np.array([0, 0]))[0] < 1e-8


MARKS = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def plain_signs(text):
    words = [w.encode() for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    n, size = max(1, len(words)), max(1, sum(map(len, words)))
    mark = lambda b: chr(b) in MARKS
    doubled = sum(len(w) >= 2 and w[-1] == w[-2] and mark(w[-1]) and w[-1] != 46 for w in words)
    shout = sum(sum(65 <= b <= 90 for b in w) >= 2 and not any(97 <= b <= 122 for b in w) for w in words)
    triples = 1 - len({tuple(words[i : i + 3]) for i in range(len(words) - 2)}) / (len(words) - 2) if len(words) >= 6 else 0
    poor = 1 - min(1, len(set(words)) / len(words) ** 0.85) if len(words) >= 20 else 0
    same = sum(a == b for a, b in zip(words, words[1:]))
    return [doubled / n, sum(mark(b) for w in words for b in w) / size, sum(w == b"|" for w in words) / n, shout / n, sum(w[-1] == 33 for w in words) / n, same / n, triples, poor, size / n if words else 0, float(not words)]


def test_signs_are_the_plain_ones():
    draw = random.Random(6)
    pieces = ["word", "WORD", "é", "a!!", "b..", "|", "x$$$", "!", "same same", "", "\t", "\x0b", "long" * 9, "Ab", "über", "1234", "a-b"]
    texts = [" ".join(draw.choice(pieces) for _ in range(draw.choice([0, 1, 5, 30, 200]))) for _ in range(300)] + ["", " \n", "a"]
    signs, _ = text_signs([t.encode() for t in texts])
    want = np.array([plain_signs(t) for t in texts])
    assert np.allclose(signs, want)
    # limits met to the last bit may fall either way
    clear = (np.abs(want - np.array([LIMITS[s] for s in SIGNS])) > 1e-9).all(1)
    votes = [sum((x >= LIMITS[s]) << j for j, (s, x) in enumerate(zip(SIGNS, row))) for row in want]
    assert (patterns(signs) == votes)[clear].all()


def test_votes_are_the_plain_ones():
    """Votes of the fixed lexicons by words of the texts; the mined lexicons are empty here."""
    draw = random.Random(8)
    strip = lambda w: re.sub(r"^[^\w]{0,3}|[^\w]{0,3}$", "", w) or w
    pieces = ["plain", "idiot", "Idiot!", "dumm", "you", "YOU", "salaud,", "odio", "words", "(scum)", "weak", "KILL", "nice"]
    texts = [" ".join(draw.choice(pieces) for _ in range(draw.choice([0, 1, 6, 60]))) for _ in range(200)]
    raws = [t.encode() for t in texts]
    indices, offsets, words = text_features(raws)
    got = Voters.of(np.zeros(0, np.int64)).patterns(indices, offsets, words, loudness(raws, words))
    for text, pattern, loud in zip(texts, got.tolist(), loudness(raws, words).tolist()):
        said = {strip(w.lower()) for w in text.split()}
        n, hits = max(1, len(text.split())), sum(len(said & set(x)) for x in LEXICONS.values())
        hits = len(said & {w for x in LEXICONS.values() for w in x})
        fired = {name for name, x in LEXICONS.items() if said & set(x)}
        fired |= {name for name, yes in (("two_hits", hits >= 2), ("three_hits", hits >= 3), ("share_of_hits", hits * 100 >= n), ("dense_hits", hits and hits * 20 >= n), ("address_and_hit", hits and said & set(ADDRESS)), ("loud_and_hit", hits and loud % 2), ("capitals_and_hit", hits and loud >= 2)) if yes}
        assert {v for j, v in enumerate(VOTERS) if pattern >> j & 1} == fired, text
