"""T1-T8 and the roles of R0 on batches of sentences, as columns of numbers.

A batch holds whole sentences, one after the other; every step is one pass over all their tokens: no loop over sentences or
tokens, and a word is looked at once a task.  -1 stands for no token.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])   # workers need not have the package on their path

CHUNK_POS = ("DET", "ADJ", "NUM", "NOUN", "PROPN")
NOUN_POS = ("NOUN", "PROPN")
DEPS = ("dep", "ROOT", "oprd", "pobj", "conj", "appos", "nsubj", "nsubjpass", "attr", "dobj", "det", "amod", "nummod", "compound",
        "prep", "cc", "advmod", "auxpass", "aux", "expl", "acl", "punct")
MOST_WORDS = 1 << 18      # that a task remembers


def whole_sentences(batches):
    """The batches, sorted by (doc_id, sent_id), as tables that no sentence goes beyond, with the number of each row's sentence."""
    import numpy as np
    import pyarrow as pa

    def numbered(t):
        new = np.zeros(t.num_rows, bool)
        for c in ("doc_id", "sent_id"):
            code = t[c].combine_chunks().dictionary_encode("encode")
            code = (code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code).indices.to_numpy(zero_copy_only=False)
            new[1:] |= code[1:] != code[:-1]
        return np.cumsum(new)

    rest = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = t if rest is None else pa.concat_tables([rest, t])
        g = numbered(t)
        last = int(np.searchsorted(g, g[-1]))
        rest = t.slice(last)
        if last:
            yield t.slice(0, last), g[:last]
    if rest is not None:
        yield rest, numbered(rest)


FLAGS = {"at": 1, "least": 2, "be": 4, "class": 8, "name": 16, "there": 32, "end": 64, "comma": 128}


class Words:
    """What is known of a word by itself; a word that the lexicon has several times has several entries, one after the other."""

    def __init__(self, lexicon):
        self.lexicon, self.pos_code = {}, {}
        for word, pos, lemma, stop in lexicon:
            if word is not None:
                self.lexicon.setdefault(word, []).append((pos, lemma, stop))
        for p in ("PUNCT", "NOUN", "NUM", "ADP", "CCONJ", "ADV", "AUX", "VERB", "PRON", "DET", "ADJ", "PROPN"):
            self._code(p)
        self._clear()

    def _code(self, pos):
        return self.pos_code.setdefault(pos, len(self.pos_code))

    def _clear(self):
        import numpy as np
        self.known, self.lemma, self.new, self.seen_by = {}, [], [], None
        self.table = np.empty((0, 3), np.int16)     # part of speech, flags, stop word

    def _learn(self, text):
        lower, ascii_ = text.lower(), text.isascii()
        is_num, is_alpha = ascii_ and text.isdigit(), ascii_ and text.isalpha()
        plural = is_alpha and len(lower) > 3 and lower.endswith("s") and not lower.endswith("ss")
        word = FLAGS[lower] if lower in ("at", "least") else FLAGS["end"] if text in (".", "!", "?") else FLAGS["comma"] if text == "," else 0
        first = len(self.lemma)
        for pos, lemma, stop in self.lexicon.get(lower, ((None, None, None),)):
            lemma = lemma if lemma is not None else lower[:-1] if plural else lower if is_alpha else text
            flags = word | (FLAGS[lemma] if lemma in ("be", "class", "name", "there") else 0)
            pos = self._code(pos if pos is not None else "NUM" if is_num else "NOUN" if is_alpha else "PUNCT")
            self.new.append((pos, flags, bool(stop)))
            self.lemma.append(lemma)
        self.known[text] = at = (first, len(self.lemma) - first)
        return at

    def entries(self, texts):
        """(first entry, number of entries) of each text."""
        import numpy as np
        if len(self.known) > MOST_WORDS:
            self._clear()
        known = self.known
        found = [known.get(x) or self._learn(x) for x in texts]
        if self.new:
            self.table, self.new = np.concatenate([self.table, np.array(self.new, np.int16)]), []
        return found


def annotated(t, g, words: Words) -> dict:
    """The tokens of the sentences of ``t`` (doc_id, sent_id, words) with the sentence numbers ``g``: columns as arrays.  ``row``
    is the row of ``t``, ``own`` the place of the text in ``texts``, ``entry`` that of the lemma in the lists of ``words``."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    lists = t["words"].combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    texts = lists.flatten().dictionary_encode()
    own, texts = texts.indices.to_numpy(zero_copy_only=False), texts.dictionary
    first, many = np.array(words.entries(texts.to_pylist()), np.int64).reshape(-1, 2).T
    row = np.repeat(np.arange(len(n)), n)
    tid = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    entry = first[own]
    if len(many) and many.max() > 1:
        k = many[own]
        row, tid, own = np.repeat(row, k), np.repeat(tid, k), np.repeat(own, k)
        entry = np.repeat(entry, k) + np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
    sent = g[row]
    if len(sent) and (np.diff(row) * (np.diff(sent) == 0)).any():     # a sentence of several rows: its tokens by place
        by = np.lexsort((tid, sent))
        row, tid, own, entry, sent = row[by], tid[by], own[by], entry[by], sent[by]
    size = len(row)
    out = {"row": row, "tid": tid, "own": own, "entry": entry, "texts": texts}
    if not size:
        return {**out, "size": 0}
    at = np.arange(size)
    starts = np.flatnonzero(np.append(True, sent[1:] != sent[:-1]))
    of = np.cumsum(np.append(False, sent[1:] != sent[:-1]))           # the sentence among those that have tokens
    start = starts[of]
    opens = at == start
    closes = np.append(opens[1:], True)

    pos, flags, stop = words.table[entry].T
    has = lambda name: flags & FLAGS[name] != 0

    def lead(x):
        return np.append(x[1:], False) & ~closes

    def lag(x):
        return np.append(False, x[:-1]) & ~opens

    def last_of(cond, strict=False):
        """The place of the last token of the sentence where it holds, up to this one, or before it."""
        p = np.maximum.accumulate(np.where(cond, at, -1))
        p = np.append(-1, p[:-1]) if strict else p
        return np.where(p >= start, p, -1)

    def lowest(cond):       # of a sentence
        x = np.minimum.reduceat(np.where(cond, tid, size + tid.max() + 1), starts)
        return np.where(x > tid.max(), -1, x)

    def highest(cond):
        return np.maximum.reduceat(np.where(cond, tid, -1), starts)

    code = words.pos_code.get
    pos = np.where(has("at") & lead(has("least")), np.int16(code("ADV")), pos)
    is_pos = lambda *names: np.isin(pos, [code(x) for x in names]) if len(names) > 1 else pos == code(names[0])
    is_be, is_class = has("be"), has("class")
    chunkable, noun = is_pos(*CHUNK_POS), is_pos(*NOUN_POS)
    adp, verb, aux = is_pos("ADP"), is_pos("VERB"), is_pos("AUX")
    is_end, comma = has("end"), has("comma")

    out_of = last_of(~chunkable)                     # the last token in no chunk: the run comes after it
    run = np.where(out_of >= 0, tid[out_of], -1)
    run_new = opens | np.append(True, run[1:] != run[:-1])
    run_starts, run_of = np.flatnonzero(run_new), np.cumsum(run_new) - 1
    run_root = np.maximum.reduceat(np.where(noun, tid, -1), run_starts)[run_of]
    chunk_root = np.where(chunkable & (tid <= run_root), run_root, -1)
    before_run = lambda cond: cond[out_of] & (out_of >= 0)
    pre_adp, pre_cconj, pre_comma = before_run(adp), before_run(is_pos("CCONJ")), before_run(comma)
    is_cr = chunk_root == tid
    p = last_of(is_cr, True)
    prev_cr = np.where(p >= 0, tid[p], -1)
    prev_chunk_root = np.where(opens, -1, np.append(-1, chunk_root[:-1]))
    is_acl = verb & has("name") & lag(is_cr) & lag(is_class)
    pre_is_acl = before_run(is_acl)

    first_be, first_cr, first_verb = lowest(aux & is_be), lowest(is_cr), lowest(verb & ~is_acl)
    n_chunks = np.add.reduceat(is_cr.astype(np.int32), starts).astype(np.int32)
    multi = np.add.reduceat((is_end & (tid < highest(opens | True)[of])).astype(np.int32), starts) > 0
    root = np.where(first_verb >= 0, first_verb, np.where(first_be >= 0, first_be, first_cr))
    r = root[of]
    later, sooner = (r >= 0) & (tid > r), (r >= 0) & (tid < r)
    nsubj, c1 = highest(is_cr & sooner & ~pre_adp), lowest(is_cr & later)
    adp_after, stop_after = lowest(adp & later), lowest((adp | verb | aux) & later)
    be_before = highest(aux & is_be & sooner)
    r_verb = first_verb >= 0
    r_be = ~r_verb & (first_be >= 0)
    nsubj = np.where(r_verb | r_be, nsubj, -1)
    dobj = np.where((r_verb | r_be) & (c1 >= 0) & ((adp_after < 0) | (adp_after > c1)), c1, -1)
    passive = r_verb & (nsubj >= 0) & (be_before >= 0) & (be_before > nsubj)
    nsubj, dobj, passive, r_be, stop_after = nsubj[of], dobj[of], passive[of], r_be[of], stop_after[of]

    appos = pre_comma & (dobj >= 0) & (tid > dobj) & ((stop_after < 0) | (tid < stop_after))
    in_chunk = chunk_root >= 0
    none = np.full(size, -1, np.int64)
    cr_rules = [
        (tid == r, "ROOT", none),
        (pre_is_acl, "oprd", run),
        (pre_adp, "pobj", run),
        (pre_cconj, "conj", np.where(prev_cr >= 0, prev_cr, r)),
        (appos, "appos", dobj),
        ((tid == nsubj) & passive, "nsubjpass", r),
        (tid == nsubj, "nsubj", r),
        ((tid == dobj) & r_be, "attr", r),
        (tid == dobj, "dobj", r),
    ]
    is_adv = is_pos("ADV")
    other_rules = [
        (tid == r, "ROOT", none),
        (in_chunk & is_pos("DET"), "det", chunk_root),
        (in_chunk & is_pos("ADJ"), "amod", chunk_root),
        (in_chunk & is_pos("NUM"), "nummod", chunk_root),
        (in_chunk, "compound", chunk_root),
        (adp, "prep", np.where(prev_chunk_root >= 0, prev_chunk_root, r)),
        (is_pos("CCONJ"), "cc", np.where(prev_cr >= 0, prev_cr, r)),
        (is_adv, "advmod", np.where(lead(is_pos("NUM") | is_adv), tid + 1, r)),
        (aux & passive & (tid > nsubj) & (tid < r), "auxpass", r),
        (aux, "aux", r),
        (is_pos("PRON") & has("there") & lead(is_be), "expl", tid + 1),
        (is_acl, "acl", tid - 1),
        (is_pos("PUNCT"), "punct", r),
    ]
    dep, head = np.zeros(size, np.int8), r.copy()
    for rules, these in ((cr_rules, is_cr), (other_rules, ~is_cr)):
        for cond, name, to in reversed(rules):       # the first that holds is set last
            cond = cond & these
            dep[cond] = DEPS.index(name)
            head[cond] = to[cond]
    head[head == tid] = -1
    return {**out, "size": size, "of": of, "starts": starts, "run_of": run_of, "run_starts": run_starts, "pos": pos, "dep": dep,
            "head": head, "is_cr": is_cr, "chunk_root": chunk_root, "n_chunks": n_chunks, "multi": multi,
            "stop": stop != 0}


def _columns(t, a, words: Words, keep=None) -> dict:
    """The columns of tokens as Arrow arrays, of the tokens that ``keep`` has."""
    import numpy as np
    import pyarrow as pa
    k = slice(None) if keep is None else keep
    row = pa.array(a["row"][k])
    # a token's lemma is one of its words', so few are made into Arrow strings
    used, lemma = np.unique(a["entry"][k], return_inverse=True)
    ints = lambda x: pa.array(x.astype(np.int32), mask=x < 0)
    flat = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    return {"doc_id": flat(t["doc_id"].take(row)), "sent_id": flat(t["sent_id"].take(row)),
            "tok_id": pa.array(a["tid"][k].astype(np.int32)), "text": a["texts"].take(pa.array(a["own"][k])),
            "lemma": pa.array([words.lemma[i] for i in used.tolist()], pa.string()).take(pa.array(lemma)),
            "head": ints(a["head"][k]), "is_stop": pa.array(a["stop"][k]), "chunk_root": ints(a["chunk_root"][k])}


def tokens_of(lexicon):
    """The function of batches of (doc_id, sent_id, words) that gives batches of the token table."""
    def run(batches):
        import pyarrow as pa
        words = Words(lexicon)
        for t, g in whole_sentences(batches):
            a = annotated(t, g, words)
            if not a["size"]:
                continue
            c = _columns(t, a, words)
            c["pos"] = pa.array(list(words.pos_code), pa.string()).take(pa.array(a["pos"]))
            c["dep"] = pa.array(DEPS, pa.string()).take(pa.array(a["dep"]))
            c["n_chunks"], c["multi_sent"] = pa.array(a["n_chunks"][a["of"]]), pa.array(a["multi"][a["of"]])
            yield pa.RecordBatch.from_pydict({x: c[x] for x in (
                "doc_id", "sent_id", "tok_id", "text", "lemma", "pos", "dep", "head", "is_stop", "chunk_root", "n_chunks", "multi_sent")})
    return run


def roles_of(lexicon, conditions, rule_bits, climbs, asked):
    """The function of batches of sentences that gives batches of the tokens that rules go on with (see the rules).

    conditions: (bit, deps, parts, lemmas, lemmas not, one sentence, one chunk) of each role, empty sets admitting all."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        words, of_lemma = Words(lexicon), np.empty(0, np.int64)

        def masks(values, sets, nots=None):
            return [sum(b for b, some, none in zip((c[0] for c in conditions), sets, nots or [()] * len(sets), strict=True)
                        if (not some or v in some) and v not in none) for v in values]
        by_dep = np.array(masks(DEPS, [c[1] for c in conditions]), np.int64)
        # lemmas that no role names have the same bits
        named, lemma_sets = sorted({v for c in conditions for s in (c[3], c[4]) for v in s}), ([c[3] for c in conditions], [c[4] for c in conditions])
        by_lemma, other = dict(zip(named, masks(named, *lemma_sets), strict=True)), masks([None], *lemma_sets)[0]
        every = sum(c[0] for c in conditions)
        for t, g in whole_sentences(batches):
            a = annotated(t, g, words)
            if not a["size"]:
                continue
            by_pos = np.array(masks(words.pos_code, [c[2] for c in conditions]), np.int64)
            if len(of_lemma) > len(words.lemma) or words.seen_by is not by_lemma:   # the words were forgotten
                of_lemma, words.seen_by = of_lemma[:0], by_lemma
            new = words.lemma[len(of_lemma):]
            of_lemma = np.concatenate([of_lemma, np.fromiter((by_lemma.get(x, other) for x in new), np.int64, len(new))])
            bits = by_dep[a["dep"]] & by_pos[a["pos"]] & of_lemma[a["entry"]]
            of = a["of"]
            for bit, _, _, _, _, one_sentence, one_chunk in conditions:
                if one_sentence:
                    bits &= np.where(a["multi"][of], every & ~bit, every)
                if one_chunk:
                    bits &= np.where((a["n_chunks"][of] == 1) & a["is_cr"], every, every & ~bit)
            met = np.bitwise_or.reduceat(bits, a["starts"])
            alive = np.zeros(len(met), np.int64)
            for own in rule_bits:
                alive |= np.where(met & own == own, own, 0)
            alive = alive[of]
            roles = bits & alive
            root = a["is_cr"] & (roles & asked != 0)
            named = np.logical_or.reduceat(root, a["run_starts"])[a["run_of"]] & (a["chunk_root"] >= 0)
            keep = np.flatnonzero((alive != 0) & ((roles != 0) | named | (alive & climbs != 0)))
            if not len(keep):
                continue
            c = _columns(t, a, words, keep)
            c["roles"] = pa.array(roles[keep])
            yield pa.RecordBatch.from_pydict({x: c[x] for x in (
                "doc_id", "sent_id", "tok_id", "text", "lemma", "is_stop", "chunk_root", "head", "roles")})
    return run
