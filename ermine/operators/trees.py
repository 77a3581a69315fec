"""Boosted stumps and a random forest over sparse vectors, exact splits.

Spark ML's trees lay every document out over the whole vocabulary, which no store holds once it has some 100,000 words.  Here
the entries that are not zero are kept by term: a task goes through the entries of its terms and finds their best split from
class sums, those of the zeros being what is left of the totals.  The driver has a few numbers a document: its label and weight.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])   # workers need not have the package on their path

BLOCK_ENTRIES = 1 << 20   # of a stored row: a task sorts some 50 MB
LEAST_GAIN = 1e-12        # what rounding may make of no gain


def _entries(col):
    """(row, index, value) of the entries of a batch of vectors that are not zero."""
    import numpy as np
    import pyarrow.compute as pc
    _, _, indices, values = col.flatten()
    n = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False)
    row, val = np.repeat(np.arange(len(n)), n), values.flatten().to_numpy(zero_copy_only=False)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)      # a dense vector's index is the place
    sparse = pc.is_valid(indices).to_numpy(zero_copy_only=False)[row]
    at[sparse] = indices.flatten().to_numpy(zero_copy_only=False)
    some = val != 0
    return row[some], at[some].astype(np.int32), val[some]


def _best_splits(terms, vals, classes, weights, totals):
    """The best split of entries in the order of (term, sign, falling size): (gain, term, sign, bound, far), far being the class
    sums of the documents whose value, taken with the sign, is above the bound; None where nothing is gained."""
    import numpy as np
    if not len(terms):
        return None
    size, sign = np.abs(vals), np.sign(vals)
    new = np.ones(len(terms), bool)
    new[1:] = (terms[1:] != terms[:-1]) | (sign[1:] != sign[:-1])
    end = np.append(new[1:], True)
    end[:-1] |= size[1:] != size[:-1]
    end = np.flatnonzero(end)
    first = np.maximum.accumulate(np.where(new, np.arange(len(terms)), 0))[end]
    far = np.empty((len(end), len(totals)))
    for c in range(len(totals)):
        sums = np.concatenate([[0.0], np.cumsum(np.where(classes == c, weights, 0.0))])
        far[:, c] = sums[end + 1] - sums[first]
    far = np.clip(far, 0.0, totals)
    near, total = totals - far, totals.sum()
    n_far, n_near = far.sum(1), near.sum(1)
    least = total * 1e-12
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = ((far ** 2).sum(1) / n_far + (near ** 2).sum(1) / n_near - (totals ** 2).sum() / total) / total
    gain = np.where((n_far > least) & (n_near > least), gain, -1.0)
    k = int(np.argmax(gain))
    if not gain[k] > LEAST_GAIN:
        return None
    at = end[k]
    below = size[at + 1] if at + 1 < len(terms) and not new[at + 1] else 0.0
    return float(gain[k]), int(terms[at]), float(sign[at]), float((size[at] + below) / 2), far[k]


class Postings:
    """The entries of (label, features) rows by term, stored, and the documents' labels, numbered from 0."""

    def __init__(self, rows: DataFrame):
        import numpy as np

        from ..session import cut_lineage
        own = cut_lineage(rows.select(F.monotonically_increasing_id().alias("at"), F.col("label").cast("double").alias("label"), "features"))
        head = own.select("features").first()
        self.width = head[0].size if head else 0
        seen = own.select("at", "label").toArrow()
        at, label = (seen[c].to_numpy() for c in ("at", "label"))
        order = np.argsort(at)
        at, label = at[order], label[order]
        parts, firsts = np.unique(at >> 33, return_index=True)
        start = dict(zip(parts.tolist(), firsts.tolist(), strict=True))
        self.n = len(label)
        self.labels, self.classes = np.unique(label, return_inverse=True)

        def count(batches):
            import pyarrow as pa
            yield pa.RecordBatch.from_pydict({"n": [sum(len(_entries(b.column(0))[0]) for b in batches)]})
        entries = own.select("features").mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0
        blocks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-entries // BLOCK_ENTRIES))

        def dealt(batches):
            import pyarrow as pa
            for b in batches:
                row, term, val = _entries(b.column("features"))
                ids = b.column("at").to_numpy()
                docs = (np.array([start[p] for p in (ids >> 33).tolist()], np.int64) + (ids & ((1 << 33) - 1))).astype(np.int32)[row]
                block = term % blocks
                by = np.argsort(block, kind="stable")
                block, docs, term, val = block[by], docs[by], term[by], val[by]
                own, first = np.unique(block, return_index=True)
                last = np.append(first[1:], len(block))
                yield pa.RecordBatch.from_pydict({"block": pa.array(own, pa.int32()), **{
                    c: pa.array([x[i:j].tobytes() for i, j in zip(first, last, strict=True)], pa.binary())
                    for c, x in (("terms", term), ("docs", docs), ("vals", val))}})

        def sorted_block(t):
            import pyarrow as pa
            term, docs, val = (np.frombuffer(b"".join(t[c].to_pylist()), d)
                               for c, d in (("terms", np.int32), ("docs", np.int32), ("vals", np.float64)))
            by = np.lexsort((docs, -np.abs(val), np.sign(val), term))
            return pa.table({"block": t["block"][:1], **{c: pa.array([x[by].tobytes()], pa.binary())
                                                        for c, x in (("terms", term), ("docs", docs), ("vals", val))}})
        schema = "block int, terms binary, docs binary, vals binary"
        self.stored = cut_lineage(own.select("at", "features").mapInArrow(dealt, schema).repartition(blocks, "block")
                                  .groupBy("block").applyInArrow(sorted_block, schema))

    @staticmethod
    def _blocks(batches):
        import numpy as np
        for b in batches:
            for t, d, v in zip(*(b.column(c) for c in ("terms", "docs", "vals")), strict=True):
                yield tuple(np.frombuffer(x.as_buffer(), k) for x, k in ((t, np.int32), (d, np.int32), (v, np.float64)))

    def best_stump(self, weights):
        """(term, sign, bound, far class, near class, which documents are far) of the best split, or None."""
        import numpy as np
        classes, n, blocks = self.classes.astype(np.int16), self.n, self._blocks
        totals = np.bincount(classes, weights, len(self.labels))

        def best(batches):
            import pyarrow as pa
            top, bits = None, b""
            for terms, docs, vals in blocks(batches):
                found = _best_splits(terms, vals, classes[docs], weights[docs], totals)
                if found and (top is None or (-found[0], found[1]) < (-top[0], top[1])):
                    top, is_far = found, np.zeros(n, bool)
                    of = (terms == found[1])
                    is_far[docs[of][vals[of] * found[2] > found[3]]] = True
                    bits = np.packbits(is_far).tobytes()      # a bit a document, one row a task
            if top:
                yield pa.RecordBatch.from_pydict({"gain": [top[0]], "term": pa.array([top[1]], pa.int32()), "sign": [top[2]],
                                                  "bound": [top[3]], "far": [top[4].tolist()], "bits": [bits]})
        rows = self.stored.select("terms", "docs", "vals").mapInArrow(
            best, "gain double, term int, sign double, bound double, far array<double>, bits binary").collect()
        if not rows:
            return None
        r = min(rows, key=lambda r: (-r.gain, r.term))
        far = np.array(r.far)
        return (r.term, r.sign, r.bound, int(np.argmax(far)), int(np.argmax(totals - far)),
                np.unpackbits(np.frombuffer(r.bits, np.uint8), count=n).astype(bool))

    def of_terms(self, asked) -> dict:
        """term: (documents, values) of the terms asked that have entries."""
        import numpy as np
        asked, blocks = np.unique(np.asarray(asked, np.int32)), self._blocks

        def some(batches):
            import pyarrow as pa
            for terms, docs, vals in blocks(batches):
                for term in asked[np.isin(asked, terms)]:
                    of = slice(*np.searchsorted(terms, [term, term + 1]))
                    yield pa.RecordBatch.from_pydict({"term": pa.array([term], pa.int32()), "docs": [docs[of].tobytes()], "vals": [vals[of].tobytes()]})
        rows = self.stored.select("terms", "docs", "vals").mapInArrow(some, "term int, docs binary, vals binary").collect()
        return {r.term: (np.frombuffer(r.docs, np.int32), np.frombuffer(r.vals, np.float64)) for r in rows}


def stump_votes(test: DataFrame, stumps: list, labels) -> DataFrame:
    """(doc_id, label, prediction): the class with the largest sum of the stumps' votes, ties to the smaller.

    stumps: (term, sign, bound, far class, near class, weight); a term of -1 has no far side."""
    import numpy as np
    near = np.zeros(len(labels))
    by_term: dict = {}
    for term, sign, bound, far, other, alpha in stumps:
        near[other] += alpha
        by_term.setdefault(term, []).append((sign, bound, far, other, alpha))
    asked, names = np.array(sorted(by_term), np.int32), np.asarray(labels)
    schema = test.select("doc_id", "label").schema.add("prediction", "integer")

    def run(batches):
        import pyarrow as pa
        for b in batches:
            row, term, val = _entries(b.column("features"))
            of = np.isin(term, asked)
            row, term, val = row[of], term[of], val[of]
            by = np.argsort(term, kind="stable")
            row, term, val = row[by], term[by], val[by]
            sums = np.tile(near, (b.num_rows, 1))
            for t, votes in by_term.items():
                here = slice(*np.searchsorted(term, [t, t + 1]))
                for sign, bound, far, other, alpha in votes:
                    is_far = row[here][val[here] * sign > bound]
                    sums[is_far, far] += alpha
                    sums[is_far, other] -= alpha
            best = names[np.argmax(np.round(sums, 9), axis=1)].astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(best)], names=["doc_id", "label", "prediction"])
    return test.select("doc_id", "label", "features").mapInArrow(run, schema)


def boosted(train: Postings, rounds: int) -> list:
    """SAMME: the stumps of at most ``rounds`` rounds.  A first round no better than chance still votes, alone."""
    import math

    import numpy as np
    w, k, stumps = np.ones(train.n), max(len(train.labels), 2), []
    for i in range(rounds if train.n else 0):
        w *= train.n / w.sum()      # only their proportions matter
        found = train.best_stump(w)
        if found is None:
            most = int(np.argmax(np.bincount(train.classes, w, len(train.labels))))
            found = (-1, 1.0, 0.0, most, most, np.zeros(train.n, bool))
        term, sign, bound, far, near, is_far = found
        miss = np.where(is_far, far, near) != train.classes
        err = float(w[miss].sum() / train.n)
        poor = err >= 1 - 1.0 / k
        if poor and i:
            break
        alpha = 1.0 if poor else math.log((1 - max(err, 1e-10)) / max(err, 1e-10)) + math.log(k - 1)
        stumps.append((term, sign, bound, far, near, alpha))
        if poor or err <= 1e-10:
            break
        w[miss] *= math.exp(alpha)
    return stumps


def grown(train: Postings, trees: int, depth: int, seed: int) -> list:
    """A random forest: bootstrapped trees, one feature drawn for each node.  A tree is a list of nodes in order of levels:
    (term, sign, bound) or None where it ends, and the class shares."""
    import numpy as np
    inner, k = 2 ** depth - 1, len(train.labels)
    draws = [np.random.default_rng([seed, t]) for t in range(trees)]
    asked = [rng.integers(max(train.width, 1), size=inner).tolist() for rng in draws]
    found = train.of_terms([x for xs in asked for x in xs]) if train.n else {}
    forest = []
    for rng, terms in zip(draws, asked, strict=True):
        w = rng.poisson(1.0, train.n).astype(float)
        at, nodes = np.zeros(train.n, np.int32), []
        sums = {0: np.bincount(train.classes, w, k)}
        for node in range(2 * inner + 1):
            have = sums.get(node)
            split = None
            if have is not None and node < inner and terms[node] in found:
                docs, vals = found[terms[node]]
                here = at[docs] == node
                docs, vals = docs[here], vals[here]
                in_bag = w[docs] > 0
                best = _best_splits(np.full(in_bag.sum(), terms[node]), vals[in_bag], train.classes[docs[in_bag]], w[docs[in_bag]], have)
                if best:
                    _, _, sign, bound, far = best
                    split = (terms[node], sign, bound)
                    sums[2 * node + 1], sums[2 * node + 2] = have - far, far
                    at[at == node] = 2 * node + 1
                    at[docs[vals * sign > bound]] = 2 * node + 2
            total = 0.0 if have is None else have.sum()
            nodes.append((split, (have / total).tolist() if total else [0.0] * k))
        forest.append(nodes)
    return forest


def forest_votes(test: DataFrame, forest: list, labels) -> DataFrame:
    """(doc_id, label, prediction): the class with the largest sum of the trees' shares, ties to the smaller."""
    import numpy as np
    asked = np.array(sorted({n[0][0] for t in forest for n in t if n[0]}), np.int32)
    names, schema = np.asarray(labels), test.select("doc_id", "label").schema.add("prediction", "integer")

    def run(batches):
        import pyarrow as pa
        for b in batches:
            row, term, val = _entries(b.column("features"))
            of = np.isin(term, asked)
            row, term, val = row[of], term[of], val[of]
            sums = np.zeros((b.num_rows, len(names)))
            for nodes in forest:
                at = np.zeros(b.num_rows, np.int32)
                for k, (split, _) in enumerate(nodes):
                    if split:
                        here = row[term == split[0]]
                        far = here[val[term == split[0]] * split[1] > split[2]]
                        far = far[at[far] == k]
                        at[at == k] = 2 * k + 1
                        at[far] = 2 * k + 2
                sums += np.array([share for _, share in nodes])[at]
            best = names[np.argmax(np.round(sums, 9), axis=1)].astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(best)], names=["doc_id", "label", "prediction"])
    return test.select("doc_id", "label", "features").mapInArrow(run, schema)
