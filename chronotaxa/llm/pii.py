"""Operator 9 [native]: information-theoretic sanitisation of personal data.

Base detectors find e-mail addresses, IPv4 addresses, payment cards and phone numbers. Corpus
co-occurrence then estimates how strongly a word reveals such an entity. Entities are taken at three levels, since
a single value seldom recurs often enough to be judged:

* a value: one address or number;
* an identity that values share: an e-mail's host and its holder (the part before @), an address's
  first three parts, a card's first six digits, what precedes the last seven digits of a phone number;
* a kind: e-mail, ip, card, phone.

With row counts n(t), n(e), n(t,e) and N, the pointwise mutual information PMI(t;e) = log2(n(t,e) N / (n(t) n(e)))
is held against the information content of the entity, IC(e) = log2(N / n(e)); their ratio is 1 if
the word gives the entity away. In documents that hold the entity, words whose ratio reaches
``generalise_at`` become a class label and those that reach ``remove_at`` are removed, wherever they stand. For a value or an
identity n(t,e) counts rows in which the word stands within ``window`` characters of it, for a kind all rows that hold both. A
pair counts only with ``min_contexts`` different contexts (the ``near`` characters on both sides of the entity, without numbers
and addresses), so that copies of one text, or of one passage, are a single piece of evidence.

A word is a run of letters and combining marks that starts with a letter and has no digit beside it, of any length, in lower case,
outside e-mail addresses.

Everything is DataFrame expressions. The base spans are found once and staged with the rows; texts are never shuffled, and
the terms go back to their rows by a join whose small side is broadcast only if it has at
most ``BROADCAST_ROWS`` rows (counted), else by a shuffled join.

Defined results: a null text counts as empty (and stays null when sanitised); an empty one has no spans.
Each row is a document of its own, whether its doc_id repeats or is null. Ties at a threshold count as
reaching it; an entity that every row holds is given away by no word. Texts of any length are read whole: arrays of spans are built in
blocks and texts cut in pieces, so the work on one text grows with its length and its spans, not with their product. Other columns of the input are carried along by ``sanitise`` and ignored by ``detect``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Stage

KINDS = ("email", "ip", "card", "phone")
BROADCAST_ROWS = 100_000
#: One row in so many, beside all rows with spans, bounds word counts from below before those that matter are counted over all rows.
_BOUND_PART = 8

#: Equal to the plain patterns under leftmost, non-overlapping search. Possessive quantifiers and
#: look-behinds keep the search linear in long runs and off the regex engine's stack.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}

#: Entries of an array, or characters of a text, that are handled at once: what is rebuilt or searched for each entry is never longer.
_BLOCK = 256
_PIECE = 4096

_DIGITS = "regexp_replace(m, '[^0-9]', '')"
_LUHN = (
    f"aggregate(sequence(1, length({_DIGITS})), 0, (s, k) -> s + "
    f"element_at(if(k % 2 = 1, array(0,1,2,3,4,5,6,7,8,9), array(0,2,4,6,8,1,3,5,7,9)), 1 + int(substr({_DIGITS}, length({_DIGITS}) - k + 1, 1)))) % 10 = 0"
)
_VALID = {
    "email": "true",
    "ip": "forall(split(m, '[.]'), p -> length(ltrim('0', p)) <= 3 and coalesce(try_cast(ltrim('0', p) as int), 0) <= 255)",
    "card": _LUHN,
    "phone": f"length({_DIGITS}) between 9 and 15",
}
_SPANS = "array<struct<start:int,ord:int,end:int,kind:string>>"
_WORD = r"(?<![\p{L}\p{M}\p{N}])\p{L}[\p{L}\p{M}]*+(?!\p{N})"
#: A character that every match of a kind holds; texts without it are not searched.
_SIGN = {"email": "instr({t}, '@') > 0", "ip": "{t} rlike '[0-9][.][0-9]'", "card": "{t} rlike '[0-9][ -]?[0-9][ -]?[0-9]'", "phone": "instr({t}, '+') > 0"}


def _sql_text(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"'") + "'"


def _in_blocks(n: str, start: str, inner: str) -> str:
    """SQL: the flattened results of ``inner`` over blocks of at most ``_BLOCK`` of ``n`` entries, so that no long array is rebuilt once an entry.

    ``inner`` sees the block number ``i`` and ``at``, the state that ``start`` (an SQL array, one entry a block) gives the block.
    """
    return f"flatten(zip_with(sequence(0, ({n} - 1) div {_BLOCK}), {start}, (i, at) -> {inner}))"


def _part(array: str) -> str:
    return f"slice({array}, i * {_BLOCK} + 1, {_BLOCK})"


def _running(n: str, of_block: str, step: str, first: str) -> str:
    """SQL: the state before each block, ``step`` joining the state ``a`` with a block's ``b``; the last entry is the state after all."""
    return f"aggregate(transform(sequence(0, ({n} - 1) div {_BLOCK}), i -> {of_block}), array({first}), (s, b) -> concat(s, array({step.format(a='element_at(s, -1)', b='b')})))"


def _fold(gaps: str, found: str, valid: str, kind: str, rank: int | str) -> str:
    """Positions of matches: the pieces between and the matches alternate, so lengths add up to offsets."""
    n = f"size({found})"
    length = f"aggregate(zip_with({_part(gaps)}, {_part(found)}, (g, m) -> coalesce(if(m is null, 0, length(g) + length(m)), 0)), 0, (x, y) -> x + y)"
    starts = f"slice({_running(n, length, '{a} + {b}', '0')}, 1, ({n} - 1) div {_BLOCK} + 1)"
    inner = f"""aggregate(
      zip_with(slice({gaps}, i * {_BLOCK} + 1, least({_BLOCK}, {n} - i * {_BLOCK})), {_part(found)}, (g, m) -> named_struct('g', length(g), 'n', length(m), 'ok', {valid}, 'ord', {rank})),
      named_struct('at', at, 'out', cast(array() as {_SPANS})),
      (a, x) -> named_struct('at', a.at + x.g + x.n, 'out',
        if(x.ok, cast(array_append(a.out, named_struct('start', a.at + x.g, 'ord', x.ord, 'end', a.at + x.g + x.n, 'kind', '{kind}')) as {_SPANS}), a.out)),
      a -> a.out)"""
    return f"if({n} = 0, cast(array() as {_SPANS}), cast({_in_blocks(n, starts, inner)} as {_SPANS}))"


def _free(both: str) -> str:
    """SQL: of sorted base and term spans, the base ones and the terms that overlap none of them.

    Terms do not overlap each other, so a base span that starts inside a term follows it directly; of those that start before it, the furthest end decides.
    """
    n = f"size({both})"
    end = "if(s.ord < 4, s.end, 0)"
    furthest = f"aggregate({_part(both)}, 0, (m, s) -> greatest(m, {end}))"
    starts = f"slice({_running(n, furthest, 'greatest({a}, {b})', '0')}, 1, ({n} - 1) div {_BLOCK} + 1)"
    follows = f"slice({both}, i * {_BLOCK} + 2, {_BLOCK})"
    inner = f"""aggregate(
      zip_with({_part(both)}, {follows}, (s, f) -> named_struct('s', s, 'f', f)),
      named_struct('end', at, 'out', cast(array() as {_SPANS})),
      (a, x) -> named_struct('end', if(x.s.ord < 4, greatest(a.end, x.s.end), a.end), 'out',
        if(x.s.ord < 4 or (a.end <= x.s.start and (x.f is null or x.f.ord >= 4 or x.f.start >= x.s.end)), cast(array_append(a.out, x.s) as {_SPANS}), a.out)),
      a -> a.out)"""
    return f"if({n} = 0, {both}, cast({_in_blocks(n, starts, inner)} as {_SPANS}))"


def _cut(pieces: str, start: str, n: str) -> str:
    """SQL: ``substr(text, start + 1, n)`` (``start`` not negative) from the text's ``pieces`` of ``_PIECE`` characters, without a walk over what lies before."""
    return f"substr(array_join(slice({pieces}, ({start}) div {_PIECE} + 1, greatest(0, ({n}) + {_PIECE} - 1) div {_PIECE} + 1), ''), ({start}) % {_PIECE} + 1, {n})"


#: SQL: a text in pieces; a position in it is found at once.
_PIECES = f"regexp_extract_all(text, r'(?s).{{1,{_PIECE}}}+', 0)"


def with_spans(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the sorted base spans of ``text``; one narrow pass of regular expressions."""
    df = df.withColumn(f"{out}_t", F.coalesce(F.col(text), F.lit("")))
    for kind in KINDS:
        df = df.withColumn(f"{out}_m_{kind}", F.expr(f"if({_SIGN[kind].format(t=f'{out}_t')}, regexp_extract_all({out}_t, {_sql_text(PATTERNS[kind])}, 0), cast(array() as array<string>))"))
    for kind in KINDS:
        df = df.withColumn(f"{out}_g_{kind}", F.expr(f"if(size({out}_m_{kind}) > 0, split({out}_t, {_sql_text(PATTERNS[kind])}, -1), cast(array() as array<string>))"))
    folds = ", ".join(_fold(f"{out}_g_{k}", f"{out}_m_{k}", _VALID[k], k, i) for i, k in enumerate(KINDS))
    df = df.withColumn(out, F.expr(f"if(size({out}_m_email) + size({out}_m_ip) + size({out}_m_card) + size({out}_m_phone) > 0, array_sort(concat({folds})), cast(array() as {_SPANS}))"))
    return df.drop(f"{out}_t", *(f"{out}_{p}_{k}" for p in "mg" for k in KINDS))


def _words(text: str) -> str:
    """SQL: the distinct words of a text."""
    plain = f"if(instr({text}, '@') > 0, regexp_replace({text}, {_sql_text(PATTERNS['email'])}, ' '), {text})"
    return f"array_distinct(regexp_extract_all(lower({plain}), {_sql_text(_WORD)}, 0))"


#: SQL: names of the entities that the value of a span ``s`` stands for, and of the identities it shares with others.
_NAMES = """case s.kind
    when 'email' then array(concat('email:', s.value), concat('host:', substring_index(s.value, '@', -1)), concat('holder:', substring_index(s.value, '@', 1)))
    when 'ip' then array(concat('ip:', s.value), concat('net:', regexp_replace(s.value, '[.][0-9]+$', '')))
    when 'card' then array(concat('card:', s.value), concat('issuer:', left(s.value, 6)))
    else array(concat('phone:', s.value), concat('area:', left(s.value, length(s.value) - 7))) end"""


def _sides(reach: int) -> str:
    """SQL: the text at most ``reach`` characters before and after a span ``s``, cut at blanks, without numbers and addresses."""
    before = f"if(s.start > {reach}, regexp_replace({_cut('pieces', f's.start - {reach}', str(reach))}, r'^\\S*', ''), {_cut('pieces', '0', 's.start')})"
    after = f"if(n_text > s.end + {reach}, regexp_replace({_cut('pieces', 's.end', str(reach))}, r'\\S*$', ''), {_cut('pieces', 's.end', str(reach))})"
    clean = lambda x: f"regexp_replace(regexp_replace(lower({x}), r'\\S*[@0-9]\\S*', ' '), r'\\s+', ' ')"
    return f"concat({clean(before)}, ' | ', {clean(after)})"


def evidence(rows: DataFrame, stage: Stage, window: int, near: int) -> tuple[DataFrame, DataFrame]:
    """(row, words, kinds) of rows with spans, kinds being (entity, context), and (row, entity, context, words) of the values and identities beside words.

    ``rows`` has row, text and pii_base. A row has one context for an entity, however often it holds it.
    """
    own = f"lower({_cut('pieces', 's.start', 's.end - s.start')})"
    span = f"named_struct('kind', s.kind, 'value', if(s.kind = 'email', {own}, regexp_replace({own}, '[^0-9.]', '')), 'context', xxhash64({_sides(near)}), 'words', array_distinct(regexp_extract_all({_sides(window)}, {_sql_text(_WORD)}, 0)))"
    kinds = ", ".join(f"array(named_struct('entity', 'kind:{k}', 'context', array_min(transform(filter(spans, s -> s.kind = '{k}'), s -> s.context))))" for k in KINDS)
    rows = rows.where("size(pii_base) > 0").withColumn("pieces", F.expr(_PIECES)).withColumn("n_text", F.length("text"))
    found = rows.select("row", F.expr(f"transform(pii_base, s -> {span})").alias("spans"), F.expr(_words("text")).alias("words"))
    held = F.expr(f"flatten(transform(spans, s -> transform({_NAMES}, e -> named_struct('entity', e, 'context', s.context, 'words', s.words))))")
    found = stage.write(found.select("row", "words", F.expr(f"filter(concat({kinds}), k -> k.context is not null)").alias("kinds"), held.alias("held")), "found")
    once = F.expr("size(array_distinct(held.entity)) = size(held)")
    each = lambda which: found.where(which).select("row", F.explode("held").alias("h")).select("row", "h.*")
    again = each(~once).groupBy("row", "entity").agg(F.min("context").alias("context"), F.array_distinct(F.flatten(F.collect_list("words"))).alias("words"))
    return found, each(once).union(again)


def _holders(found: DataFrame, beside: DataFrame) -> DataFrame:
    """(row, entity, context) of all three levels."""
    return beside.select("row", "entity", "context").union(found.select("row", F.explode("kinds").alias("k")).select("row", "k.entity", "k.context"))


def _ratio(n_all: int):
    """PMI(t;e) over IC(e); null where every row holds the entity."""
    return F.log2(F.col("n_te") * F.lit(n_all) / (F.col("n_t") * F.col("n_e"))) / F.nullif(F.log2(F.lit(n_all) / F.col("n_e")), F.lit(0.0))


def _if_few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def disclosures(rows: DataFrame, found: DataFrame, beside: DataFrame, stage: Stage, min_contexts: int, generalise_at: float) -> DataFrame:
    """(entity, term, n_te, n_t, n_e, ratio) of the words that give an entity away."""
    n_all = rows.count()
    entity = _holders(found, beside).groupBy("entity", "context").agg(F.count("*").alias("n")).groupBy("entity").agg(F.sum("n").alias("n_e"), F.count("*").alias("n_contexts"))
    # An entity with fewer contexts has no word with that many.
    entity = _if_few(stage.write(entity.where(F.col("n_contexts") >= min_contexts).drop("n_contexts"), "entity"))
    kinds = found.select("words", F.explode("kinds").alias("k")).select("k.entity", "k.context", "words")
    each = kinds.union(beside.select("entity", "context", "words")).join(entity.select("entity"), "entity").select("entity", "context", F.explode("words").alias("term"))
    pairs = (
        each.groupBy("entity", "term", "context")
        .agg(F.count("*").alias("n"))
        .groupBy("entity", "term")
        .agg(F.sum("n").alias("n_te"), F.count("*").alias("n_contexts"))
        .where(F.col("n_contexts") >= min_contexts)
        .drop("n_contexts")
        .join(entity, "entity")
    )
    # A word stands in at least as many rows as in a part of them: pairs that fail even with that count need no count of all.
    others = rows.where(f"size(pii_base) = 0 and row % {_BOUND_PART} = 0").select(F.explode(F.expr(_words("text"))).alias("term"))
    least = found.select(F.explode("words").alias("term")).union(others).groupBy("term").agg(F.count("*").alias("n_t"))
    pairs = stage.write(pairs.join(least, "term").where(_ratio(n_all) >= generalise_at).drop("n_t"), "pairs")
    terms = stage.write(pairs.select("term").distinct(), "terms")
    words = rows.select(F.explode(F.expr(_words("text"))).alias("term"))
    if (n_terms := terms.count()) <= BROADCAST_ROWS:
        words = words.join(F.broadcast(terms), "term", "left_semi") if n_terms else words.limit(0)
    n_t = words.groupBy("term").agg(F.count("*").alias("n_t")).join(terms, "term", "left_semi")
    telling = pairs.join(n_t, "term").withColumn("ratio", _ratio(n_all)).where(F.col("ratio") >= generalise_at)
    return stage.write(telling.select("entity", "term", "n_te", "n_t", "n_e", "ratio"), "telling")


def _listed(found: DataFrame, beside: DataFrame, telling: DataFrame, stage: Stage, remove_at: float) -> DataFrame:
    """(row, general, removed): the row's own words that give away an entity of the row."""
    hit = found.select("row", F.explode("words").alias("term")).join(_if_few(telling), "term")
    held = _holders(found, beside).join(_if_few(telling.select("entity").distinct()), "entity", "left_semi").select("row", "entity")
    hit = hit.join(held, ["row", "entity"], "left_semi").groupBy("row", "term").agg(F.max("ratio").alias("ratio"))
    gone = F.col("ratio") >= remove_at
    return stage.write(hit.groupBy("row").agg(F.collect_list(F.when(~gone, F.col("term"))).alias("general"), F.collect_list(F.when(gone, F.col("term"))).alias("removed")), "listed")


def annotate(docs: DataFrame, *, window: int = 256, near: int = 64, min_contexts: int = 3, generalise_at: float = 0.75, remove_at: float = 0.9) -> DataFrame:
    """The rows of ``docs`` with ``pii_base`` and ``pii_spans``: sorted arrays of (start, ord, end, kind)."""
    stage = Stage(docs.sparkSession, "pii")
    columns = docs.columns
    rows = stage.write(with_spans(docs.withColumn("row", F.monotonically_increasing_id()), "text", "pii_base"), "rows")
    found, beside = evidence(rows, stage, window, near)
    telling = disclosures(rows, found, beside, stage, min_contexts, generalise_at)
    told = _listed(found, beside, telling, stage, remove_at)
    few = told.count() <= BROADCAST_ROWS
    df = rows.join(F.broadcast(told) if few else told.hint("shuffle_hash"), "row", "left")
    text = "coalesce(text, '')"
    some = "removed is not null"
    df = df.withColumn("pii_m", F.expr(f"if({some}, regexp_extract_all({text}, {_sql_text(_WORD)}, 0), cast(array() as array<string>))"))
    df = df.withColumn("pii_g", F.expr(f"if({some}, split({text}, {_sql_text(_WORD)}, -1), cast(array() as array<string>))"))
    valid = "array_contains(removed, lower(m)) or array_contains(general, lower(m))"
    df = df.withColumn("pii_s", F.expr(f"if({some}, {_fold('pii_g', 'pii_m', valid, 'term', 'if(array_contains(removed, lower(m)), 5, 4)')}, cast(array() as {_SPANS}))"))
    df = df.withColumn("pii_b", F.expr("if(size(pii_s) > 0, array_sort(concat(pii_base, pii_s)), pii_base)"))
    df = df.withColumn("pii_spans", F.expr(f"if(size(pii_s) > 0, {_free('pii_b')}, pii_base)"))
    return df.select(*columns, "pii_base", "pii_spans")


def _joined(spans: str) -> str:
    return f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"


def detect(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, counts by kind, the hash of the base spans, all spans."""
    count = lambda kind: F.expr(f"cast(size(filter(pii_base, s -> s.kind = '{kind}')) as bigint)").alias(f"n_{kind}")
    return annotate(docs.select("doc_id", "text"), **options).select("doc_id", *map(count, KINDS), F.expr(f"sha2({_joined('pii_base')}, 256)").alias("base_sha256"), F.expr(_joined("pii_spans")).alias("spans"))


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with base spans replaced by [KIND], generalised words by [TERM], and removed words gone."""
    label = "case s.ord when 0 then '[EMAIL]' when 1 then '[IP]' when 2 then '[CARD]' when 3 then '[PHONE]' when 4 then '[TERM]' else '' end"
    n = "size(pii_spans)"
    furthest = f"aggregate({_part('pii_spans')}, 0, (m, s) -> greatest(m, s.end))"
    starts = f"slice({_running(n, furthest, 'greatest({a}, {b})', '0')}, 1, ({n} - 1) div {_BLOCK} + 1)"
    inner = f"""aggregate({_part('pii_spans')},
      named_struct('at', at, 'out', cast(array() as array<string>)),
      (a, s) -> named_struct('at', greatest(a.at, s.end), 'out',
        if(s.start < a.at, a.out, cast(concat(a.out, array({_cut('pii_pieces', 'a.at', 's.start - a.at')}, {label})) as array<string>))),
      a -> a.out)"""
    last = "aggregate(pii_spans, 0, (m, s) -> greatest(m, s.end))"
    out = f"""if(text is null or {n} = 0, text, concat(array_join({_in_blocks(n, starts, inner)}, ''), {_cut('pii_pieces', last, f'length(text) - {last}')}))"""
    # The other columns travel in one struct, so that their names cannot clash with the working columns.
    packed = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("pii_row"))
    done = annotate(packed, **options).withColumn("pii_pieces", F.expr(_PIECES)).withColumn("text", F.expr(out))
    return done.select(*(F.col("text") if c == "text" else F.col("pii_row").getField(c).alias(c) for c in docs.columns))
