"""Toxicity by weak supervision: many noisy voters, a generative label model, and a linear classifier on its posteriors.

Voters look at the words of a text and speak or are silent. Lexicon voters (`LEXICONS`, one for each language and kind) speak where one of their words
occurs; pattern voters on a form of writing; mined voters on a word or word beginning that goes with label 1 among the
labelled documents. Labels choose and calibrate voters: one that is mostly wrong there is left out. No voter is the label itself.

The label model is a mixture over the hidden label of labelled and unlabelled documents alike. For either label it has a tree of voters: the
probability that a voter speaks depends on the label and on whether its parent in the tree speaks. So accuracies and correlations are both parameters,
and voters that say the same thing twice count once. The tree joins the voters of most mutual information given the label. All is estimated by EM, which starts
from whether any voter speaks; the counts of the labelled documents are added to those expected, as a prior, but the
posterior of a document comes from its votes alone.

The classifier is logistic regression on the presence of words and word beginnings, fitted to the posteriors. Its features are those that go with
posterior label 1 far beyond chance.

Everything is fitted on at most `fit_rows` labelled and UNLABELLED other documents, with FIT_BYTES of features for the first and half of that
for the others (documented bounds); all documents are scored, whole, where they lie.

Defined cases: null and empty texts have no word and get the score of the bias; without labels of both classes the label model has only the lexicons
and patterns to go by, uncalibrated, and without any labelled text every score is about 2e-22; repeated rows are each scored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .labelled import FIT_BYTES, labelled_sample, sample_features, score_texts, unlabelled_sample
from .tokens import slices

FIT_ROWS = 12_000
BUCKETS = 1 << 22
BEGINNINGS = (3, 4, 5, 6)
#: Documents that a mined voter or a feature has to occur in, and how many standard errors it has to be off chance.
SUPPORT, FAR = 5, 6.0
#: Mined voters: how many at most, the documents that one has to occur in, and how far off chance it is. The least share of label 1 among a voter's documents.
MINED_VOTERS, VOTER_SUPPORT, VOTER_FAR, MINED_SHARE = 200, 4, 5.0, 0.8
#: How many mined voters should know a document.
COVER = 8
#: Smoothing of a voter's probabilities, what twice the information of an edge has to be for all documents, and rounds in which the tree may change.
SMOOTH, EDGE, TREE_ROUNDS = 2.0, 10.0, 10
#: Documents without a label in the label model, and documents whose votes are taken as numbers at once.
UNLABELLED, VOTES_AT_ONCE = 6_000, 1_024
WORD = re.compile(r"[^\W_]+")

LEXICONS = {
    "en_insult": "idiot moron stupid dumb loser clown scum trash worthless pathetic disgusting imbecile fool jerk creep freak pig rat vermin filth",
    "en_obscene": "fuck fucking shit bitch bastard asshole crap dick cunt slut whore",
    "en_threat": "kill murder hang die rape stab shoot destroy burn",
    "de_insult": "idiot dummkopf trottel arschloch depp vollidiot abschaum versager blödmann schwein dreckig widerlich wertlos erbärmlich",
    "fr_insult": "idiot imbécile crétin connard salaud ordure minable stupide débile abruti merde pute pathétique",
    "es_insult": "idiota imbécil estúpido estúpida basura payaso escoria inútil patético asqueroso cabrón mierda puta tonto",
}
PATTERNS = {
    "shouting": re.compile(r"(?:\b[^\W\d_]{2,}\b[!?.]*\s+){6,}", re.UNICODE),
    "exclaiming": re.compile(r"[!?]{3,}"),
    "address": re.compile(r"\b(?:you|du|tu|vous|ihr)\b[^.\n]{0,20}\b(?:idiot|moron|loser|scum|trash|clown|fool)", re.IGNORECASE),
    "masked": re.compile(r"\b\w+[*@#$]{2,}\w+\b"),
}


def bucket(gram: str) -> int:
    return xxhash.xxh64_intdigest(gram) % BUCKETS


class Words:
    """Feature buckets of a text: its words and their beginnings. Remembers chunks up to a bound."""

    def __init__(self, only: dict[int, int] | None = None, limit: int = 300_000):
        self.only, self.limit = only, limit
        self.chunks: dict[str, tuple[int, ...]] = {}

    def of_chunk(self, chunk: str) -> tuple[int, ...]:
        found = set()
        for w in WORD.findall(chunk.lower()):
            found.add(bucket("w" + w))
            found.update(bucket("b" + w[:n]) for n in BEGINNINGS if len(w) >= n)
        if self.only is not None:
            return tuple(self.only[b] for b in found if b in self.only)
        return tuple(found)

    def __call__(self, text: str) -> set[int]:
        if len(self.chunks) > self.limit:
            self.chunks.clear()
        known, out = self.chunks, set()
        for c in set(text.split()):
            if (b := known.get(c)) is None:
                b = known[c] = self.of_chunk(c)
            if b:
                out.update(b)
        return out


def pattern_votes(text: str) -> int:
    """Bit i is set where pattern i occurs; shouting needs capitals as well."""
    bits = 0
    for i, (name, pattern) in enumerate(PATTERNS.items()):
        hit = pattern.search(text)
        if hit and (name != "shouting" or any(m.group().isupper() for m in pattern.finditer(text))):
            bits |= 1 << i
    return bits


def in_blocks(votes: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """The votes as numbers, some documents at a time, so that the driver never holds all of them so."""
    for i in range(0, len(votes), VOTES_AT_ONCE):
        at = slice(i, min(i + VOTES_AT_ONCE, len(votes)))
        yield at, votes[at].astype(np.float64)


def dependency_tree(votes: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The parent of each voter, -1 for none: a maximum spanning tree of mutual information given the label, without edges that chance explains."""
    n, size = votes.shape
    information = np.zeros((size, size))
    spoken, together = np.zeros((2, size)), np.zeros((2, size, size))
    for at, block in in_blocks(votes):
        for y, w in enumerate((1 - p[at], p[at])):
            spoken[y] += w @ block
            together[y] += (block.T * w) @ block
    for y, w in enumerate((1 - p, p)):
        total = w.sum()
        one = (spoken[y] + 0.5) / (total + 1)
        a, b = one[:, None], one[None, :]
        both = (together[y] + a * b) / (total + 1)
        for joint, apart in ((both, a * b), (a - both, a * (1 - b)), (b - both, (1 - a) * b), (1 - a - b + both, (1 - a) * (1 - b))):
            joint = np.clip(joint, 1e-9, 1)
            information += total / n * joint * np.log(joint / np.clip(apart, 1e-12, 1))
    np.fill_diagonal(information, -1)
    parent, best, source, left = np.full(size, -1), information[0].copy(), np.zeros(size, np.int64), np.ones(size, bool)
    left[0] = False
    while left.any():
        j = int(np.where(left, best, -9).argmax())
        left[j] = False
        if 2 * n * best[j] > EDGE:
            parent[j] = source[j]
        nearer = information[j] > best
        source[nearer], best = j, np.maximum(best, information[j])
    return parent


def label_model(votes: np.ndarray, start: np.ndarray, known: np.ndarray | None = None, label: np.ndarray | None = None, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of label 1 for each row of votes (True where a voter speaks), P(voter speaks | label, parent speaks) and each voter's parent.

    start holds the posteriors to begin with. known, label: votes of documents whose label is known, whose counts are added to the expected ones.
    """
    n = len(votes)
    if not votes.shape[1]:
        return start, np.zeros((2, 2, 0)), np.zeros(0, np.int64)
    rows = np.vstack([votes, known]) if known is not None else votes
    sure = label.astype(np.float64) if label is not None else np.zeros(0)
    p, parent = np.clip(start, 0.02, 0.98), np.full(votes.shape[1], -1)
    rate = np.zeros((2, 2, votes.shape[1]))
    for i in range(rounds):
        every = np.r_[p, sure]
        if i < TREE_ROUNDS:
            parent = dependency_tree(rows, every)
        spoken, parents, both = np.zeros((3, 2, votes.shape[1]))
        for at, block in in_blocks(rows):
            above = block[:, np.maximum(parent, 0)] * (parent >= 0)
            for y, w in enumerate((1 - every[at], every[at])):
                spoken[y] += w @ block
                parents[y] += w @ above
                both[y] += w @ (block * above)
        for y, total in enumerate(((1 - every).sum(), every.sum())):
            alone = (spoken[y] + 0.5) / (total + 1)
            rate[y, 1] = (both[y] + SMOOTH * alone) / (parents[y] + SMOOTH)
            rate[y, 0] = (spoken[y] - both[y] + SMOOTH * alone) / (total - parents[y] + SMOOTH)
        evidence = np.zeros((2, n))
        for at, block in in_blocks(rows[:n]):
            above = block[:, np.maximum(parent, 0)] * (parent >= 0)
            for y in (0, 1):
                chance = np.clip(np.where(above > 0, rate[y, 1], rate[y, 0]), 1e-6, 1 - 1e-6)
                evidence[y, at] = (block * np.log(chance) + (1 - block) * np.log1p(-chance)).sum(axis=1)
        prior = np.clip(p.mean(), 1e-3, 1 - 1e-3)
        new = 1 / (1 + np.exp(-np.clip(evidence[1] - evidence[0] + np.log(prior / (1 - prior)), -50, 50)))
        settled = np.abs(new - p).max(initial=0) < 1e-4
        p = new
        if settled:
            break
    return p, rate, parent


def z_scores(rows: list[np.ndarray], p: np.ndarray, support: int = SUPPORT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features in `support` rows or more, the share of label 1 among their rows, and its standard errors above the mean."""
    n = np.zeros(BUCKETS, np.int32)  # a fixed size, whatever the rows hold
    for r in rows:  # the features of a row are distinct
        n[r] += 1
    feature = np.flatnonzero(n >= support)
    n, place = n[feature], n
    place[:] = 0  # for all features that occur too seldom
    place[feature] = np.arange(1, len(feature) + 1)
    ones = np.zeros(len(feature) + 1)
    for r, q in zip(rows, p, strict=True):
        ones[place[r]] += q
    ones, mean = ones[1:], p.mean()
    error = np.sqrt(max(mean * (1 - mean), 1e-6) / n)
    return feature, ones / n, (ones / n - mean) / error


def mine_voters(rows: list[np.ndarray], label: np.ndarray) -> np.ndarray:
    """Features that go with label 1, each in turn the one that knows the most documents still known by fewer than COVER."""
    feature, share, z = z_scores(rows, label.astype(np.float64), VOTER_SUPPORT)
    good = feature[(z >= VOTER_FAR) & (share >= MINED_SHARE)]
    if not len(good):
        return good
    known = [np.flatnonzero(np.isin(good, r, assume_unique=True)) for r, y in zip(rows, label, strict=True) if y]
    holders: list[list[int]] = [[] for _ in good]
    for d, at in enumerate(known):
        for f in at.tolist():
            holders[f].append(d)
    left = np.full(len(known), COVER)
    gain = np.array([len(h) for h in holders])
    chosen: list[int] = []
    while len(chosen) < MINED_VOTERS and gain.max() >= VOTER_SUPPORT:
        f = int(gain.argmax())
        chosen.append(f)
        gain[f] = 0
        for d in holders[f]:
            left[d] -= 1
            if left[d] == 0:
                gain[[x for x in known[d].tolist() if gain[x]]] -= 1
    return good[chosen]


def votes_of(rows: list[np.ndarray], patterns: np.ndarray, mined: np.ndarray) -> np.ndarray:
    groups = [np.array([bucket("w" + w) for w in words.split()]) for words in LEXICONS.values()] + [np.array([m]) for m in mined]
    owner: dict[int, list[int]] = {}
    for i, members in enumerate(groups):
        for b in members.tolist():
            owner.setdefault(b, []).append(i)
    votes = np.zeros((len(rows), len(groups) + len(PATTERNS)), bool)
    keys = np.array(sorted(owner))
    for i, r in enumerate(rows):
        for b in r[np.isin(r, keys)].tolist():
            votes[i, owner[b]] = True
    for i in range(len(PATTERNS)):
        votes[:, len(groups) + i] = patterns >> i & 1
    return votes


def fit_logistic(rows: list[np.ndarray], size: int, target: np.ndarray, l2: float = 1e-4, rounds: int = 500) -> tuple[np.ndarray, float]:
    """Soft-target logistic regression by accelerated gradient descent on sparse 0/1 rows."""
    place, feature = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows) if rows else np.zeros(0, np.int64)
    w, bias = np.zeros(size), 0.0
    ahead, ahead_bias, t = w, bias, 1.0
    rate = 4.0 / (1 + max((len(r) for r in rows), default=0))
    for _ in range(rounds):
        margin = np.bincount(place, weights=ahead[feature], minlength=len(rows)) + ahead_bias
        off = (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - target) / len(rows)
        new = ahead - rate * (np.bincount(feature, weights=off[place], minlength=size) + l2 * ahead)
        new_bias = ahead_bias - rate * off.sum()
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, ahead_bias = new + (t - 1) / t_new * (new - w), new_bias + (t - 1) / t_new * (new_bias - bias)
        w, bias, t = new, new_bias, t_new
    return w, bias


@dataclass
class ToxicityModel:
    index: dict[int, int]  # feature bucket to place
    weights: np.ndarray
    bias: float

    def score(self, features: Iterable[int]) -> float:
        margin = float(self.weights[np.fromiter(features, np.int64)].sum()) + self.bias
        return float(1 / (1 + np.exp(-np.clip(margin, -500, 500))))


def fit_model(rows: list[np.ndarray], patterns: np.ndarray, label: np.ndarray) -> ToxicityModel:
    """rows: sorted feature buckets of each text; label: 0 or 1, or -1 where it is not known."""
    known = label >= 0
    if not known.any() or not sum(map(len, rows)):
        return ToxicityModel({}, np.zeros(0), -50.0)
    own, truth = [r for r, k in zip(rows, known, strict=True) if k], label[known]
    votes = votes_of(rows, patterns, mine_voters(own, truth))
    if truth.any() and not truth.all():
        spoken = votes[known].sum(axis=0)
        right = votes[known & (label == 1)].sum(axis=0)
        votes = votes[:, (spoken >= VOTER_SUPPORT) & (right >= MINED_SHARE * spoken)]
        prior = votes[known], truth
    else:
        prior = None, None
    p, _, _ = label_model(votes, np.where(votes.any(axis=1), 0.95, 0.03), *prior)
    feature, share, z = z_scores(rows, p)
    feature = feature[(z >= FAR) & (share >= 0.5)]
    at = [np.searchsorted(feature, r[np.isin(r, feature)]) for r in rows]
    w, bias = fit_logistic(at, len(feature), p)
    return ToxicityModel({int(f): i for i, f in enumerate(feature)}, w, bias)


def fit_toxicity(docs: DataFrame, labels: DataFrame, usable, *, label: str = "toxic", fit_rows: int = FIT_ROWS, key: str = "doc_id", text: str = "text") -> ToxicityModel:
    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for rows, texts in slices(batches):
            data = [np.array(sorted(words(t)), "<i4").tobytes() for t in texts]
            marks = pa.array(list(map(pattern_votes, texts)), pa.int32())
            yield pa.RecordBatch.from_arrays([rows.column("order"), rows.column("label"), marks, pa.array(data, pa.binary())], names=["order", "label", "patterns", "data"])

    kind = "order long, label int, patterns int, data binary"
    found = sample_features(labelled_sample(docs, labels, label, usable, fit_rows, key=key, text=text), features, kind, fit_rows)
    if found:
        found += sample_features(unlabelled_sample(docs, labels, usable, UNLABELLED, key=key, text=text), features, kind, UNLABELLED, FIT_BYTES // 2)
    rows = [np.frombuffer(r.data, "<i4") for r in found]
    return fit_model(rows, np.array([r.patterns for r in found], np.int64), np.array([r.label for r in found], np.int64))


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, text: str = "text") -> DataFrame:
    """docs, packed as struct `doc`, with score."""
    fitted = docs.sparkSession.sparkContext.broadcast(model)

    def scorer():
        words = Words(only=fitted.value.index)
        return lambda t: fitted.value.score(words(t))

    return score_texts(docs, scorer, text=text)
