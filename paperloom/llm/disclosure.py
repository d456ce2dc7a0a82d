"""Personal data by information-theoretic sanitisation, in DataFrame operations only.

Patterns find e-mail and IP addresses, card and telephone numbers. Each distinct
value is a protected entity. From the words around its places, the corpus tells
how strongly a term reveals it: their pointwise mutual information, log2 of
p(entity | term) / p(entity), against the entity's information content, -log2
p(entity). A term that gives away more than a share of that content is disclosed
by the texts that hold the entity, so there it is a finding, too: removed if it
tells the entity for certain, else generalised.

A text's matches and the pieces between them are rows; lengths summed up over
those before give the places, so the work grows with the text and no faster.
Equal texts are looked at once, and count as often as they are there; the terms
that keep an entity's company have to do so in several different texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm._common import join_spread, own, staged

#: The base patterns in the order in which kinds are listed. Quantifiers that cannot give back are possessive, and a match starts where its run of characters does, so that long runs take linear time.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = (*PATTERNS, "term")
PARTS_OF_IP = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$"
CARD_DIGITS, PHONE_DIGITS = (13, 19), (9, 15)
#: What a text with a match holds at least.
SIGNS = r"@|\+[0-9]|[0-9]\.[0-9]+\.[0-9]|[0-9](?:[\x20-]?[0-9]){12}"

#: Characters on either side of an entity whose words count as its company.
NEAR = 160
#: Letters of a term at least, and distinct texts in which it has to keep an entity's company.
LETTERS = 3
SUPPORT = 3
#: Share of an entity's information content that a term may not give away.
SHARE = 0.9
BETWEEN_WORDS = r"[^\p{L}]+"
#: Terms that are broadcast at most; more are joined after all terms are counted.
TERMS = 200_000
#: Characters of a piece from which texts are put together.
PIECE = 2000


def _valid(kind: Column, hit: Column) -> Column:
    """Whether a match of a kind (its number) is one."""
    digits = F.regexp_replace(hit, "[^0-9]", "")
    card = F.length(digits).between(*CARD_DIGITS) & F.call_function("luhn_check", F.substring(digits, 1, CARD_DIGITS[1]))
    return F.when(kind == 0, True).when(kind == 1, hit.rlike(PARTS_OF_IP)).when(kind == 2, card).otherwise(F.length(digits).between(*PHONE_DIGITS))


def _places(pieces: DataFrame, by: list[str]) -> DataFrame:
    """From ``pieces`` and ``hits``, what stands between the matches of a pattern and they themselves: a row for each piece with its place ``i``, ``start`` (of the match after it) and ``hit``, null after the last."""
    each = pieces.select(*by, "hits", F.posexplode("pieces").alias("i", "piece")).withColumn("hit", F.get("hits", F.col("i"))).drop("hits")
    before = Window.partitionBy(*by).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    passed = F.coalesce(F.sum(F.length("piece") + F.length("hit")).over(before), F.lit(0))
    return each.withColumn("start", passed + F.length("piece")).withColumn("next", F.lead("piece").over(Window.partitionBy(*by).orderBy("i")))


def matches(texts: DataFrame) -> DataFrame:
    """key, kind (its number), start, end, hit and the text ``left`` and ``right`` of every base match in ``texts`` (key, text)."""
    kinds = [F.struct(F.lit(k).alias("kind"), F.split("text", p, -1).alias("pieces"), F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias("hits")) for k, p in enumerate(PATTERNS.values())]
    rows = _places(texts.select("key", F.inline(F.array(*kinds))).filter(F.size("hits") > 0), ["key", "kind"]).filter("hit is not null")
    # a word that the window cuts is left out
    left = F.when(F.length("piece") > NEAR, F.regexp_replace(F.expr(f"right(piece, {NEAR})"), r"^\p{L}+", "")).otherwise(F.col("piece"))
    right = F.when(F.length("next") > NEAR, F.regexp_replace(F.expr(f"left(next, {NEAR})"), r"\p{L}+$", "")).otherwise(F.coalesce("next", F.lit("")))
    found = rows.select("key", "kind", "start", (F.col("start") + F.length("hit")).alias("end"), "hit", left.alias("left"), right.alias("right"))
    return found.filter(_valid(F.col("kind"), F.col("hit")))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), BETWEEN_WORDS), lambda t: F.length(t) >= LETTERS))


def disclosed(docs: DataFrame, company: DataFrame, n_docs: int, support: int = SUPPORT, share: float = SHARE, most: int = TERMS) -> DataFrame:
    """kind, value, term, n_texts (in which the term keeps the entity's company) and certain (it stands nowhere else): terms that give away ``share`` of an entity's content or more.

    ``company``: key, n (how often it is there), kind, value and terms of every
    text's entities; ``docs``: all texts (text), for how often a term stands anywhere.
    """
    held = company.select("key", "n", "kind", "value").distinct().groupBy("kind", "value").agg(F.sum("n").alias("n_entity"))
    pairs = company.select("key", "n", "kind", "value", F.explode("terms").alias("term")).distinct()
    met = pairs.groupBy("kind", "value", "term").agg(F.count("*").alias("n_texts"), F.sum("n").alias("met")).filter(F.col("n_texts") >= support)
    met = staged(met.join(held, ["kind", "value"]))
    wanted = staged(met.select("term").distinct())
    n_wanted = wanted.count()
    if not n_wanted:
        return met.select("kind", "value", "term", "n_texts", F.lit(False).alias("certain"))
    anywhere = docs.select(F.explode(_terms(F.col("text"))).alias("term"))
    if n_wanted <= most:
        anywhere = anywhere.join(F.broadcast(wanted), "term")
    counts = anywhere.groupBy("term").agg(F.count("*").alias("n_term"))
    content = F.log2(F.lit(float(n_docs)) / F.col("n_entity"))
    told = F.log2(F.col("met") * F.lit(float(n_docs)) / (F.col("n_entity") * F.col("n_term")))
    return met.join(counts, "term").filter((content > 0) & (told >= share * content)).select("kind", "value", "term", "n_texts", (F.col("met") == F.col("n_term")).alias("certain"))


def _spans(docs: DataFrame, support: int, share: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``docs`` (doc_id, text) as keys, the texts that may hold something, and key, kind, start, end and mark of all findings in them."""
    held = staged(docs.select("doc_id", F.md5("text").alias("key"), F.when(F.col("text").rlike(SIGNS), F.col("text")).alias("text")))
    texts = staged(held.filter("text is not null").groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("n")))
    base = staged(matches(texts))
    value = F.when(F.col("kind") == 0, F.lower("hit")).when(F.col("kind") == 1, F.col("hit")).otherwise(F.regexp_replace("hit", "[^0-9]", ""))
    company = staged(base.join(texts.select("key", "n"), "key").select("key", "n", "kind", value.alias("value"), _terms(F.concat_ws(" ", "left", "right")).alias("terms")))
    told = staged(disclosed(docs.select("text"), company, held.count(), support, share))
    pairs = company.select("key", "kind", "value", F.explode("terms").alias("term")).distinct()
    known = join_spread(pairs, told, ["kind", "value", "term"], "n_texts", pairs.count()).groupBy("key", "term").agg(F.max("certain").alias("certain"))
    known = staged(known)
    words = texts.join(known.select("key").distinct(), "key").select("key", F.split("text", BETWEEN_WORDS, -1).alias("pieces"), F.regexp_extract_all("text", F.lit(BETWEEN_WORDS), F.lit(0)).alias("hits"))
    words = _places(words, ["key"]).select("key", F.lower("piece").alias("term"), (F.col("start") - F.length("piece")).alias("start"), F.col("start").alias("end"))
    mark = F.when(F.col("certain"), "").otherwise("[term]")
    terms = words.join(known, ["key", "term"]).select("key", F.lit(len(PATTERNS)).alias("kind"), "start", "end", mark.alias("mark"))
    names = F.array(*map(F.lit, PATTERNS))
    found = base.select("key", "kind", "start", "end", F.concat(F.lit("["), F.get(names, F.col("kind")), F.lit("]")).alias("mark")).unionByName(terms)
    # a term within a base match is part of it
    before = Window.partitionBy("key").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    until = F.max(F.when(F.col("kind") < len(PATTERNS), F.col("end"))).over(before)
    found = found.withColumn("until", until).filter((F.col("kind") < len(PATTERNS)) | (F.col("start") >= F.coalesce("until", F.lit(0)))).drop("until")
    return held, texts, found


def scan(docs: DataFrame, support: int = SUPPORT, share: float = SHARE) -> DataFrame:
    """doc_id and ``found`` (an array of kind, start, end in code points, by kind as in ``KINDS`` and start) of every row's whole text.

    A null or empty text has none. Rows repeat as they are, and count each; a null doc_id is an id
    like any other; other columns are ignored; an empty table gives no rows.
    """
    held, texts, found = _spans(docs.select("doc_id", "text"), support, share)
    lists = found.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("spans"))
    names = F.array(*map(F.lit, KINDS))
    named = F.transform("spans", lambda s: F.struct(F.get(names, s["kind"]).alias("kind"), s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end")))
    lists = staged(texts.select("key", "n").join(lists, "key").select("key", "n", named.alias("found")))
    some = held.select("doc_id", "key").filter("key is not null")
    with_spans = join_spread(some, lists, ["key"], "n", some.count()).select("doc_id", "found")
    none = F.array().cast(lists.schema["found"].dataType).alias("found")
    bare = held.join(lists.select("key"), "key", "left_anti").select("doc_id", none)
    return with_spans.unionByName(bare)


def sanitised(docs: DataFrame, support: int = SUPPORT, share: float = SHARE) -> DataFrame:
    """``docs`` with the findings in ``text`` replaced by their kind, and terms that tell an entity for certain removed; overlapping findings are replaced by the marks of both.

    All columns and rows stay; a null stays null; n_chars is not counted again;
    an empty table gives no rows.
    """
    key, new = own("key", docs), own("text", docs)
    _, texts, found = _spans(docs.select("doc_id", "text"), support, share)
    along = Window.partitionBy("key").orderBy("start", "kind")
    done = F.coalesce(F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = found.withColumn("from", done).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "from", "end", "mark"))).alias("cuts"), F.max("end").alias("last"))
    whole = texts.join(cuts, "key").withColumn("pieces", F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)))

    def between(a: Column, b: Column) -> Column:
        """The text from code point ``a`` to ``b``, from the pieces that it touches."""
        touched = F.sequence(F.floor(a / PIECE).cast("int"), F.floor((b - 1) / PIECE).cast("int"))
        first = lambda k: F.greatest(a - k * PIECE, F.lit(0))
        part = lambda k: F.get("pieces", k).substr((first(k) + 1).cast("int"), (F.least(b - k * PIECE, F.lit(PIECE)) - first(k)).cast("int"))
        return F.when(b > a, F.array_join(F.transform(touched, part), "")).otherwise("")

    marked = F.transform("cuts", lambda c: F.concat(between(c["from"], c["start"]), c["mark"]))
    fresh = staged(whole.select(F.col("key").alias(key), "n", F.concat(F.array_join(marked, ""), between(F.col("last"), F.length("text").cast("long"))).alias(new)))
    keyed = docs.withColumn(key, F.md5("text"))
    changed = join_spread(keyed, fresh.withColumnRenamed("n", own("n", docs)), [key], own("n", docs), docs.count())
    same = keyed.join(fresh.select(key), key, "left_anti").withColumn(new, F.col("text"))
    return changed.unionByName(same).select(*[F.col(new).alias(c) if c == "text" else F.col(c) for c in docs.columns])
