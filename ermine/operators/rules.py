"""Dependency-pattern rules as data, compiled into joins over the token table.

A rule is an anchor role plus steps ``child > parent`` (direct dependent) or
``child >> parent`` (any descendant), each with IN / NOT_IN sets over lemma,
part of speech and dependency label.  All rules are matched together: one scan
of the tokens finds who can play which role of which rule, sentences that lack a
role of a rule drop out, and step k then joins the k-th role of every rule on
``(rule, doc_id, sent_id, parent = head)``.  ``ROOT >> x`` is a same-sentence join
(every token descends from the root); a descendant below a non-root role climbs
the head chain from the few candidate tokens by pointer doubling.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lexicon import phrases_df
from ..session import cut_lineage, cut_lineage_by
from .annotate import TOKEN_FIELDS, chunk_names, lexicon_entries, packed, sentence_words, token_names, unpacked
from .kernel import roles_of

KEY = ["doc_id", "sent_id"]
NOUNS = ("NOUN", "PROPN")
ANY = -1             # the key of a role below the root: no token has this id
HAVE_FAMILY = ("have", "contain", "include", "comprise")


@dataclass(frozen=True)
class Role:
    name: str
    parent: str | None = None
    op: str = ">"
    lemma: tuple = ()
    lemma_not: tuple = ()
    pos: tuple = ()
    dep: tuple = ()


@dataclass(frozen=True)
class Rule:
    rid: str
    kind: str
    roles: tuple
    # result template: name sources are (name_kind, role) with name_kind in pascal / camel / explicit / lemma
    cls: tuple | None = None
    attrs: tuple = ()
    attr_type: str | None = None
    src: tuple | None = None
    dst: tuple | None = None
    rel_name: tuple | None = None       # ("lemma", role) or None for ''
    multiplicity: bool = False          # T6 phrase lookup (R11)
    single_sentence: bool = False       # T8
    single_chunk: bool = False          # R4: exactly one chunk, rooted at the anchor
    distinct: tuple = field(default=())  # pairs of roles that must differ (V25 fix)


def R(name, parent=None, op=">", lemma=(), lemma_not=(), pos=(), dep=()):
    as_t = lambda v: (v,) if isinstance(v, str) else tuple(v)
    return Role(name, parent, op, as_t(lemma), as_t(lemma_not), as_t(pos), as_t(dep))


# ---- fixed values: the seventeen patterns (roles and results) -----------------
RULES = [
    Rule("R1", "class",
         (R("copula", lemma="be"), R("subject", "copula", dep="nsubj"),
          R("object", "copula", dep="attr", lemma="class")),
         cls=("pascal", "subject")),
    Rule("R2", "class",
         (R("copula", lemma=("be", "exist")), R("subject", "copula", dep="expl"),
          R("object", "copula", dep=("attr", "npadvmod", "dobj"), pos=NOUNS)),
         cls=("pascal", "object")),
    Rule("R3", "class",
         (R("noun", pos=NOUNS, lemma_not=("class", "Class"), dep="ROOT"),),
         cls=("pascal", "noun"), single_sentence=True),
    Rule("R4", "class",
         (R("noun", pos=NOUNS, lemma=("class", "Class"), dep="ROOT"),
          R("complement", "noun", dep=("amod", "compound"))),
         cls=("explicit", "noun"), single_sentence=True, single_chunk=True),
    Rule("R5", "class",
         (R("have", dep="ROOT", pos="VERB", lemma=HAVE_FAMILY), R("subject", "have", dep="nsubj"),
          R("object", "have", dep="dobj")),
         cls=("pascal", "subject"), attrs=(("camel", "object"),), attr_type=None),
    Rule("R6", "class",
         (R("klass", lemma=("class", "Class"), dep="ROOT"), R("named", "klass", pos="VERB", lemma="name"),
          R("object", "named", dep="oprd")),
         cls=("pascal", "object")),
    Rule("R7", "class",
         (R("copula", lemma="be", dep="ROOT"), R("component", "copula", dep="attr", lemma=("component", "part")),
          R("package", "component", op=">>", lemma="package"), R("subject", "copula", dep="nsubj")),
         cls=("pascal", "subject")),
    Rule("R8", "class",
         (R("have", dep="ROOT", lemma=HAVE_FAMILY), R("subject", "have", dep="nsubj"),
          R("first_object", "have", dep="dobj"), R("second_object", "first_object", dep="appos"),
          R("cc_and", "second_object", dep="cc", lemma="and"), R("last_object", "second_object", dep="conj")),
         cls=("pascal", "subject"),
         attrs=(("pascal", "first_object"), ("pascal", "second_object"), ("pascal", "last_object")), attr_type=""),
    Rule("R9", "class",
         (R("have", dep="ROOT", lemma=HAVE_FAMILY), R("subject", "have", dep="nsubj"),
          R("first_object", "have", dep="dobj"), R("cc_and", "first_object", dep="cc", lemma="and"),
          R("last_object", "first_object", dep="conj")),
         cls=("pascal", "subject"), attrs=(("pascal", "first_object"), ("pascal", "last_object")), attr_type=""),
    Rule("R10", "rel",
         (R("have", dep="ROOT", pos="VERB", lemma=("have", "contain")), R("subject", "have", dep="nsubj"),
          R("object", "have", dep="dobj")),
         src=("pascal", "subject"), dst=("pascal", "object")),
    Rule("R11", "rel",
         (R("verb", lemma="have"), R("subject", "verb", dep="nsubj"), R("object", "verb", dep="dobj"),
          R("number", "object", pos="NUM", dep="nummod"), R("adverb", "number", dep="advmod")),
         src=("pascal", "subject"), dst=("pascal", "object"), multiplicity=True),
    Rule("R12", "rel",
         (R("verb", dep="ROOT", pos="VERB"), R("subject", "verb", dep="nsubjpass", pos=NOUNS),
          R("by", "verb", pos="ADP"), R("object", "by", dep="pobj", pos=NOUNS)),
         src=("pascal", "object"), dst=("pascal", "subject"), rel_name=("lemma", "verb")),
    Rule("R13", "rel",
         (R("composed", lemma=("compose", "associate"), dep="ROOT"), R("subject", "composed", dep="nsubjpass"),
          R("object", "composed", op=">>", pos=NOUNS)),
         src=("pascal", "subject"), dst=("pascal", "object"), distinct=(("subject", "object"),)),
    Rule("R14", "rel",
         (R("verb", lemma_not=("be", "exist"), dep="ROOT"), R("subject", "verb", dep="nsubj"),
          R("object", "verb", dep="dobj")),
         src=("pascal", "subject"), dst=("pascal", "object"), rel_name=("lemma", "verb")),
    Rule("R15", "rel",
         (R("verb", dep="ROOT", lemma_not=("be", "exist")), R("subject", "verb", dep="nsubj"),
          R("object", "verb", op=">>", dep="pobj")),
         src=("pascal", "subject"), dst=("pascal", "object"), rel_name=("lemma", "verb")),
    Rule("R16", "rel",
         (R("noun", pos=NOUNS, dep="ROOT"), R("with_", "noun", pos="ADP", dep="prep", lemma="with"),
          R("object", "with_", pos=NOUNS, dep="pobj")),
         src=("pascal", "noun"), dst=("pascal", "object")),
    Rule("R17", "rel",
         (R("copula", lemma="be", dep="ROOT"), R("subject", "copula", dep="nsubj"),
          R("complement", "copula", dep="attr"), R("prep", "complement", pos="ADP"),
          R("noun", "prep", dep="pobj")),
         src=("pascal", "noun"), dst=("pascal", "subject"), rel_name=("lemma", "complement")),
]
RULES_BY_ID = {r.rid: r for r in RULES}

HIT_COLUMNS = ["doc_id", "sent_id", "rule", "kind", "cls", "attr1", "attr2", "attr3", "attr_type",
               "src", "dst", "mult", "rel_name", "mult_ambiguous"]


def _bits_of(column: str, asked: list[tuple]) -> F.Column:
    """The bits whose sets admit the value of ``column``; ``asked`` has (bit, IN set, NOT_IN set), empty ones admit all.

    A value is compared once with each string that any role names, and not once a role; null is in no set."""
    by_mask: dict[int, list] = {}
    for v in sorted({x for _, some, none in asked for x in (*some, *none)}):
        mask = sum(b for b, some, none in asked if (not some or v in some) and v not in none)
        by_mask.setdefault(mask, []).append(v)
    long = lambda mask: F.lit(mask).cast("long")
    out = F.when(F.col(column).isNull(), long(sum(b for b, some, none in asked if not some and not none)))
    for mask, values in by_mask.items():
        out = out.when(F.col(column).isin(*values), long(mask))
    return out.otherwise(long(sum(b for b, some, _ in asked if not some)))


def descendant_pairs(tokens: DataFrame, cand: DataFrame, store=cut_lineage) -> DataFrame:
    """(doc_id, sent_id, desc, anc) for every candidate token and each of its ancestors.

    Pointer doubling over the sentences that hold a candidate: pass k knows the ancestors nearer than 2^k and the
    jump of 2^k heads, so a chain of n heads takes about log2(n) passes, each a stored table.  It ends when a pass finds
    nothing new; so it does where heads go round, and every token of the round is then an ancestor of the others.
    """
    sents = cand.select(*KEY).distinct()
    jump = store(tokens.filter(F.col("head").isNotNull()).join(sents, KEY, "left_semi")
                 .select(*KEY, F.col("tok_id").alias("cur"), F.col("head").alias("far")))
    known = cand.select(*KEY, F.col("tok_id").alias("desc"), F.col("tok_id").alias("anc")).distinct()
    n = -1
    while True:
        step = known.join(jump.withColumnRenamed("cur", "anc"), [*KEY, "anc"]).select(*KEY, "desc", F.col("far").alias("anc"))
        known = store(known.unionByName(step).distinct())
        before, n = n, known.count()
        if n == before:
            return known.filter(F.col("desc") != F.col("anc"))
        jump = store(jump.join(jump.select(*KEY, F.col("cur").alias("far"), F.col("far").alias("next")), [*KEY, "far"])
                     .select(*KEY, "cur", F.col("next").alias("far")))


def _closure(rule: Rule, role: Role) -> bool:
    """A descendant below a role that need not be the root."""
    return role.op == ">>" and next(r for r in rule.roles if r.name == role.parent).dep != ("ROOT",)


def _sources(rule: Rule) -> dict[str, tuple]:
    """The names that a result shows, by its columns: (kind of name, role)."""
    named = {"cls": rule.cls, **{f"attr{i + 1}": a for i, a in enumerate(rule.attrs)}, "src": rule.src, "dst": rule.dst,
             "rel_name": rule.rel_name}
    return {c: x for c, x in named.items() if x}


def _asked_bits(rules: list[Rule], *kinds: str) -> int:
    """The bits of the roles whose name of one of ``kinds`` some result shows."""
    mask, n = 0, 0
    for rule in rules:
        for role in rule.roles:
            mask |= (1 << n) * any(kind in kinds and name == role.name for kind, name in _sources(rule).values())
            n += 1
    return mask


def _asked(rules: list[Rule], *kinds: str) -> F.Column:
    """Whether a token has one of those bits."""
    return F.col("roles").bitwiseAND(F.lit(_asked_bits(rules, *kinds)).cast("long")) != 0


NAMES = ("pascal", "camel", "explicit", "lemma")


def role_tokens(tokens: DataFrame, rules: list[Rule]) -> DataFrame:
    """The tokens that rules go on with: (doc_id, sent_id, tok_id, text, lemma, is_stop, chunk_root, head, roles).

    One scan of the tokens meets the conditions of every role of every rule, a bit of ``roles`` each (63 at most), in the
    order of the rules and their roles.  Only sentences that have a token for each role of a rule keep that rule's bits.  What
    stays is tokens with a bit, the chunks that they are the root of, for names, and whole sentences of rules that climb heads or
    look phrases up.
    """
    sets, more, whole, climbs = [], {}, [], 0   # a bit for each role, its sets; further conditions; the bits of each rule
    for rule in rules:
        own = 0
        for k, role in enumerate(rule.roles):
            bit = 1 << len(sets)
            own |= bit
            sets.append((bit, role))
            if k == 0 and rule.single_sentence:
                more[bit] = ~F.col("multi_sent")
            if k == 0 and rule.single_chunk:
                only = (F.col("n_chunks") == 1) & (F.col("chunk_root") == F.col("tok_id"))
                more[bit] = more[bit] & only if bit in more else only
        whole.append(F.lit(own).cast("long"))
        if rule.multiplicity or any(_closure(rule, role) for role in rule.roles):
            climbs |= own

    def union(masks):
        return reduce(lambda a, b: a.bitwiseOR(b), masks)

    every = (1 << len(sets)) - 1
    bits = _bits_of("dep", [(b, r.dep, ()) for b, r in sets]).bitwiseAND(_bits_of("pos", [(b, r.pos, ()) for b, r in sets])) \
        .bitwiseAND(_bits_of("lemma", [(b, r.lemma, r.lemma_not) for b, r in sets]))
    for bit, cond in more.items():
        bits = bits.bitwiseAND(F.when(cond, F.lit(every).cast("long")).otherwise(F.lit(every & ~bit).cast("long")))
    t = tokens.select(*KEY, "tok_id", "text", "lemma", "is_stop", "chunk_root", "head", bits.alias("roles"))
    t = t.withColumn("met", F.bit_or("roles").over(W.partitionBy(*KEY)))
    alive = union([F.when(F.col("met").bitwiseAND(x) == x, x).otherwise(F.lit(0).cast("long")) for x in whole])
    t = t.withColumn("met", alive).filter("met <> 0").withColumn("roles", F.col("roles").bitwiseAND(F.col("met")))
    root = F.max((F.col("chunk_root") == F.col("tok_id")) & _asked(rules, *NAMES)).over(W.partitionBy(*KEY, "chunk_root"))
    t = t.withColumn("named", F.coalesce(root, F.lit(False)))
    return t.filter((F.col("roles") != 0) | F.col("named") | (F.col("met").bitwiseAND(F.lit(climbs).cast("long")) != 0)) \
        .drop("met", "named")


def sentence_roles(sents: DataFrame, lexicon: DataFrame, rules: list[Rule]) -> DataFrame:
    """:func:`role_tokens` of the tokens of (doc_id, sent_id, sentence) rows that are dealt out by ``doc_id``: annotated and met with the
    conditions in one pass over batches of sentences, so that the other tokens are never rows."""
    conditions, whole, climbs = [], [], 0
    for rule in rules:
        own = 0
        for k, role in enumerate(rule.roles):
            bit = 1 << len(conditions)
            own |= bit
            conditions.append((bit, role.dep, role.pos, role.lemma, role.lemma_not, k == 0 and rule.single_sentence,
                               k == 0 and rule.single_chunk))
        whole.append(own)
        if rule.multiplicity or any(_closure(rule, role) for role in rule.roles):
            climbs |= own
    words = sentence_words(sents)
    of = {f.name: f for f in TOKEN_FIELDS}
    schema = T.StructType([*words.select(*KEY).schema.fields, *[of[c] for c in (
        "tok_id", "text", "lemma", "is_stop", "chunk_root", "head")], T.StructField("roles", T.LongType())])
    return words.mapInArrow(roles_of(lexicon_entries(lexicon), conditions, whole, climbs, _asked_bits(rules, *NAMES)), schema)


def role_rows(kept: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule, role, doc_id, sent_id, tok_id, key) of :func:`role_tokens`.  ``key`` is the token that the parent role must be:
    the head, or ``ANY`` where any token below the root will do."""
    at, n = [], 0
    for rule in rules:
        for k, role in enumerate(rule.roles):
            key = F.col("head") if role.op == ">" else F.lit(ANY)
            at.append(F.when(F.col("roles").bitwiseAND(F.lit(1 << n).cast("long")) != 0, F.struct(
                F.lit(rule.rid).alias("rule"), F.lit(k).alias("role"), key.cast("int").alias("key"))))
            n += 1
    # one role after the other would be a scan each: few tokens have any, so they get an array
    return kept.filter("roles <> 0").select(*KEY, "tok_id", F.explode(F.array_compact(F.array(*at))).alias("r")) \
        .select(*KEY, "tok_id", "r.*")


def _held(df: DataFrame, pieces: int | None) -> DataFrame:
    """The side of a join that a task holds: a piece of text's rows are few, so they take no sort."""
    return df.hint("shuffle_hash") if pieces else df


def match(kept: DataFrame, rules: list[Rule], store=cut_lineage, pieces: int | None = None) -> DataFrame:
    """All matches of all rules, (rule, doc_id, sent_id, t): ``t`` has the ``tok_id`` of each role, in order.

    Step k joins the k-th role of every rule at once, so there are as many joins as the longest rule has roles.  Matches of
    rules that have no k-th role go along, so that nothing is put together afterwards: where tokens are dealt out by ``doc_id``,
    so are the matches.  The rows of the roles are stored: each step reads its own, and does not go through all conditions again.
    """
    rows = store(role_rows(kept, rules))
    m = rows.filter("role = 0").select("rule", *KEY, F.array("tok_id").alias("t"))
    for k in range(1, max(len(r.roles) for r in rules)):
        more = [r for r in rules if len(r.roles) > k]
        nxt = rows.filter(F.col("role") == k).select("rule", *KEY, "key", F.col("tok_id").alias("n"))
        for rule in more:
            if _closure(rule, rule.roles[k]):
                here = F.col("rule") == rule.rid
                below = descendant_pairs(kept, rows.filter(here & (F.col("role") == k)), store).select(
                    F.lit(rule.rid).alias("rule"), *KEY, F.col("anc").alias("above"), F.col("desc").alias("n"))
                nxt = nxt.join(below, ["rule", *KEY, "n"], "left").filter(~here | F.col("above").isNotNull()) \
                    .select("rule", *KEY, F.coalesce("above", "key").alias("key"), "n")
        parent = F.coalesce(*[F.when(F.col("rule") == r.rid, [x.name for x in r.roles].index(r.roles[k].parent) + 1)
                              for r in more])
        anywhere = [r.rid for r in more if r.roles[k].op == ">>" and not _closure(r, r.roles[k])]
        m = m.withColumn("parent", F.element_at("t", parent))
        m = m.withColumn("key", F.when(F.col("rule").isin(anywhere), ANY).otherwise(F.col("parent")) if anywhere else F.col("parent"))
        ended = ~F.col("rule").isin([r.rid for r in more])
        m = m.join(_held(nxt, pieces), ["rule", *KEY, "key"], "left").filter(ended | (F.col("n") != F.col("parent")))
        m = m.select("rule", *KEY, F.when(ended, F.col("t")).otherwise(F.concat("t", F.array("n"))).alias("t"))
    for rule in rules:
        at = [r.name for r in rule.roles]
        for a, b in rule.distinct:
            m = m.filter((F.col("rule") != rule.rid) | (F.element_at("t", at.index(a) + 1) != F.element_at("t", at.index(b) + 1)))
    return m


def multiplicity(tokens: DataFrame, matched: DataFrame) -> DataFrame:
    """T6 + T7 on the sentences of ``matched`` (doc_id, sent_id, adverb):
    first phrase by start, then longest; flag when it does not cover the adverb."""
    spark = tokens.sparkSession
    sents = matched.select(*KEY).distinct()
    t = tokens.select(*KEY, "tok_id", "text").join(sents, KEY, "left_semi")
    w = W.partitionBy(*KEY).orderBy("tok_id")
    grams = [F.col("text")]
    for k in range(1, 4):
        grams.append(F.concat_ws(" ", grams[-1], F.lead("text", k).over(w)))
    g = t.select(*KEY, "tok_id", F.array(*[F.struct(F.lit(i + 1).alias("n"), x.alias("gram"))
                                            for i, x in enumerate(grams)]).alias("gs"))
    # a 4-gram at the sentence end has fewer words: keep only full n-grams
    g = g.select(*KEY, "tok_id", F.explode("gs").alias("g")).select(*KEY, "tok_id", "g.n", "g.gram")
    g = g.filter(F.size(F.split("gram", " ")) == F.col("n"))
    ph = F.broadcast(phrases_df(spark))
    hits = g.join(ph, (g.gram == ph.phrase) & (g.n == ph.n_words)).select(*KEY, "tok_id", "n", "mult")
    best = (hits.withColumn("rk", F.row_number().over(W.partitionBy(*KEY).orderBy("tok_id", F.desc("n"))))
            .filter("rk = 1").select(*KEY, F.col("tok_id").alias("p_start"), F.col("n").alias("p_len"), "mult"))
    return (matched.join(best, KEY, "left")
            .select(*KEY, "adverb", F.coalesce("mult", F.lit("")).alias("mult"),
                    (F.col("p_start").isNotNull()
                     & ~((F.col("p_start") <= F.col("adverb"))
                         & (F.col("adverb") <= F.col("p_start") + F.col("p_len")))).alias("mult_ambiguous")))


def hits(tokens: DataFrame | None, names: DataFrame | None, rules: list[Rule], pieces: int | None = None,
         kept: DataFrame | None = None) -> DataFrame:
    """R0c + R0d + action: one result row per (sentence, rule); the last match wins that has a result.

    ``names``: the name view of the tokens; without it, the tokens that can play a role get theirs.  ``pieces``: the partitions
    that the tokens are dealt out to by ``doc_id``; all that follows then stays in them, and nothing is exchanged.  ``kept``: the
    tokens that rules go on with, where they were made of sentences (:func:`sentence_roles`); no token table is asked then."""
    store = (lambda df: cut_lineage_by(df, "doc_id", pieces)) if pieces else cut_lineage
    kept = unpacked(store(packed(role_tokens(tokens, rules) if kept is None else kept)))
    if names is None:
        named = kept.filter(_asked(rules, *NAMES))
        names = token_names(named, _held(chunk_names(kept), pieces)).join(_held(named.select(*KEY, "tok_id", "roles"), pieces), [*KEY, "tok_id"])
        names = names.withColumns({c: F.when(_asked(rules, c), F.col(c)) for c in NAMES})
    # one name a token; asked several times, so stored
    names = store(names.groupBy(*KEY, "tok_id").agg(F.max(F.struct(*NAMES)).alias("n")).select(*KEY, "tok_id", "n.*"))

    def by_rule(value):
        """``value(rule)`` where it is not None, as a column over ``rule``."""
        cases = [F.when(F.col("rule") == r.rid, c) for r in rules if (c := value(r)) is not None]
        return F.coalesce(*cases, F.lit(None).cast("string")) if cases else F.lit(None).cast("string")

    def token(rule, role):
        return F.element_at("t", [r.name for r in rule.roles].index(role) + 1)

    def with_names(m, columns):
        """``m`` with the name of its token for the one of ``columns`` that a rule has, as the column ``said``."""
        at = [F.when(F.col("rule") == r.rid, token(r, x[1])) for r in rules for c, x in _sources(r).items() if c in columns]
        if not at:
            return m.withColumn("said", F.lit(None).cast("string"))
        own = names.select(*KEY, F.col("tok_id").alias("own"), F.struct(*NAMES).alias("said"))
        m = m.withColumn("own", F.coalesce(*at)).join(_held(own, pieces), [*KEY, "own"], "left").drop("own")
        return m.withColumn("said", by_rule(lambda r: next((F.col(f"said.{x[0]}") for c, x in _sources(r).items() if c in columns), None)))

    m = with_names(store(match(kept, rules, store, pieces)), ("cls",)).withColumnRenamed("said", "cls")
    # a null result does not overwrite
    m = m.filter(F.col("cls").isNotNull() | ~F.col("rule").isin([r.rid for r in rules if r.cls]))
    m = m.select("rule", *KEY, F.col("t").alias("at"), F.struct("cls", "t").alias("shown"))
    m = m.groupBy("rule", *KEY).agg(F.max_by("shown", "at").alias("m")).select("rule", *KEY, "m.*")
    adverbs = [F.when(F.col("rule") == r.rid, token(r, "adverb")) for r in rules if r.multiplicity]
    m = m.withColumn("adverb", F.coalesce(*adverbs, F.lit(None).cast("int")))
    # the other names of what is picked; a rule has attributes or ends, so one join serves a column of each
    is_class = F.col("rule").isin([r.rid for r in rules if r.cls])
    for attr, end in (("attr1", "src"), ("attr2", "dst"), ("attr3", "rel_name")):
        m = with_names(m, (attr, end)).withColumns({attr: F.when(is_class, F.col("said")), end: F.when(~is_class, F.col("said"))})
        m = m.drop("said")
    m = m.select(
        *KEY, "rule", by_rule(lambda r: F.lit(r.kind)).alias("kind"), "cls", "attr1", "attr2", "attr3",
        by_rule(lambda r: F.lit(r.attr_type) if r.attrs and r.attr_type is not None else None).alias("attr_type"),
        "src", "dst", by_rule(lambda r: F.lit("") if r.src else None).alias("mult"),
        by_rule(lambda r: F.coalesce("rel_name", F.lit("")) if r.src or r.rel_name else None).alias("rel_name"),
        F.lit(False).alias("mult_ambiguous"), "adverb")
    for rule in rules:
        if rule.multiplicity:
            found = multiplicity(kept, m.filter(F.col("rule") == rule.rid).select(*KEY, "adverb")).select(
                F.lit(rule.rid).alias("rule"), *KEY, "adverb", F.col("mult").alias("said"), F.col("mult_ambiguous").alias("unsure"))
            m = m.join(found, ["rule", *KEY, "adverb"], "left").withColumns({
                "mult": F.coalesce("said", "mult"), "mult_ambiguous": F.coalesce("unsure", "mult_ambiguous")}).drop("said", "unsure")
    return m.select(*HIT_COLUMNS)


def rule_hits(tokens: DataFrame | None, rule: Rule, names: DataFrame | None = None, pieces: int | None = None,
              kept: DataFrame | None = None) -> DataFrame:
    """The results of one rule."""
    return hits(tokens, names, [rule], pieces, kept)
