"""Quotation linking: nested quotes are parsed, hashed, joined to their originals and taken out of the conversation.

A line's quote level is the number of leading > marks. Lines of equal level that follow one another are one passage;
its text is normalised (lower case, runs of anything but letters and digits as one space) sentence by sentence, so that
re-wrapped and shortened quotes still match. A passage whose sentences are those of a whole earlier message comes from that
message, the latest such one. Any other comes from the earlier message that holds most of its sentences (the later message
on ties), by votes over every earlier message that says one. A message replies to the source of its outermost quote, by most sentences. Roots and depths follow by
pointer doubling; conversations are then ordered by root, depth and turn, so that a message stands after the one that it
replies to, and `position` numbers that order; rows of one turn stand by role and a hash of their text.

All steps are DataFrame functions. Messages of equal sentences are one class and vote once, as do equal passages; the latest earlier
turn of a class comes from a range-partitioned sort, so that a message said thousands of times is neither one task nor
thousands of pairs. Votes for a passage meet every distinct message that shares a sentence with it; positions come from a range-partitioned sort and counts for each partition, so that
a conversation with a third of all rows is not one task.

Defined cases: messages with equal conversation and turn are one message to link to, while each row keeps its own text; a null
conversation is a conversation of its own; a null turn sorts first and is neither linked nor linked to; a null text
is empty; quotes without an original leave reply_to null; a message without quotes is a root; attribution lines ("On ...
wrote:") directly above a quote go with it; quotes of the message itself or of later ones are not links; an empty table gives no rows; a text is read
whole, however long; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowproof.session import saved

MARKS = r"^[ \t]*(>[> \t]*)"
ATTRIBUTION = r"^[ \t]*On .+ wrote:[ \t\r]*$"
MAX_DOUBLINGS = 40


def parsed(text: Column) -> Column:
    """The lines of a text as structs (level, body)."""
    marks = lambda x: F.regexp_extract(x, MARKS, 1)
    level = lambda x: F.length(F.regexp_replace(marks(x), "[^>]", ""))
    quoted = lambda x: F.startswith(F.ltrim(x, F.lit(" \t")), F.lit(">"))
    read = lambda x: F.when(quoted(x), F.struct(level(x).alias("level"), F.regexp_replace(x, MARKS, "").alias("body"))).otherwise(F.struct(F.lit(0).alias("level"), x.alias("body")))
    return F.transform(F.split(text, "\n", -1), read)


def _next(lines: Column, i: Column) -> Column:
    return F.try_element_at(lines, (i + 2).cast("int"))


def own_text(lines: Column) -> Column:
    """The text without quoted lines, without attributions above them, and without blank lines at its ends."""
    attribution = lambda x, i: (F.coalesce(_next(lines, i)["level"], F.lit(0)) > 0) & F.rlike(x["body"], F.lit(ATTRIBUTION))
    kept = F.filter(lines, lambda x, i: (x["level"] == 0) & ~attribution(x, i))
    return F.btrim(F.array_join(F.transform(kept, lambda x: x["body"]), "\n"), F.lit("\n\r"))


def passages(lines: Column) -> Column:
    """Quoted passages in order: structs (level, body), one for each run of lines of equal level over zero."""
    starts = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (i == 0) | (F.get(lines, i)["level"] != F.coalesce(F.get(lines, F.greatest(i - 1, F.lit(0)))["level"], F.lit(-1))))
    run = lambda at: lambda i, k: F.struct(F.get(lines, i)["level"].alias("level"), F.slice(lines, i + 1, F.coalesce(F.get(at, k + 1), F.size(lines)) - i).alias("run"))
    runs = F.get(F.transform(F.array(starts), lambda at: F.transform(at, run(at))), F.lit(0))  # the starts are found once
    quoted = F.filter(runs, lambda r: r["level"] > 0)
    return F.transform(quoted, lambda r: F.struct(r["level"].alias("level"), F.array_join(F.transform(r["run"], lambda x: x["body"]), "\n").alias("body")))


def sentence_hashes(text: Column) -> Column:
    """The distinct hashes of a text's normalised sentences."""
    flat = F.regexp_replace(F.lower(text), r"\s+", " ")
    plain = F.regexp_replace(F.regexp_replace(flat, r"(?<=[.!?]) ", "\n"), r"[^\p{L}\p{N}\n]+", " ")
    sentences = F.filter(F.transform(F.split(plain, "\n", -1), lambda s: F.btrim(s)), lambda s: s != "")
    return F.array_distinct(F.transform(sentences, lambda s: F.struct(F.xxhash64(s).alias("a"), F.xxhash64(F.lit("s"), s).alias("b"))))


def _whole(text: Column) -> Column:
    """Two hashes of the sorted hashes of a text's sentences, and how many there are; the sentences are hashed once."""
    made = lambda h: F.struct(F.xxhash64(h).alias("wa"), F.xxhash64(F.lit("m"), h).alias("wb"), F.size(h).cast("long").alias("n"))
    return F.get(F.transform(F.array(F.array_sort(sentence_hashes(text))), made), F.lit(0))


def _keyed(rows: DataFrame, a: str, b: str) -> DataFrame:
    """rows with two hashes of their sorted sentence hashes `h`."""
    return rows.withColumns({a: F.xxhash64("h"), b: F.xxhash64(F.lit("m"), "h")})


def facts(messages: DataFrame) -> DataFrame:
    """messages (with lines) with the text of their own, its whole hash, and those of the passages that they quote."""
    bare = messages.withColumns({"own": own_text(F.col("lines")), "_passages": passages(F.col("lines"))}).drop("lines")
    quoted = F.transform("_passages", lambda p: F.struct(p["level"].alias("level"), _whole(p["body"]).alias("w")))
    return bare.withColumns({"whole": _whole(F.col("own")), "quoted": quoted}).drop("_passages")


def latest_before(said: DataFrame, asked: DataFrame, group: list[str]) -> DataFrame:
    """asked (group, turn) with `source`, the latest turn of the group in `said` before it, where there is one."""
    both = [rows.select(*group, "turn", F.lit(is_said).alias("_said")).distinct() for rows, is_said in ((said, True), (asked, False))]
    ranged = both[0].unionByName(both[1]).repartitionByRange(*group, "turn", "_said")
    held = saved(ranged.select("*", F.spark_partition_id().alias("_part")), "events")
    # A group is ordered within each of its partitions; at one turn, what is asked stands before what is said.
    near = F.last(F.when(F.col("_said"), F.col("turn")), ignorenulls=True)
    order = Window.partitionBy(*group, "_part").orderBy("turn", "_said").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = held.withColumn("source", near.over(order)).where("not _said").drop("_said")
    # A group over several partitions: the end of the last partition before, one row for each.
    ends = held.where("_said").groupBy(*group, F.col("_part").alias("_before")).agg(F.max("turn").alias("_end"))
    spans = held.where("not _said").select(*group, "_part").distinct().join(ends, group).where("_before < _part")
    carried = spans.groupBy(*group, "_part").agg(F.max("_end").alias("_end"))
    out = found.join(carried, [*group, "_part"], "left").select(*group, "turn", F.coalesce("source", "_end").alias("source"))
    return out.where("source is not null")


def _voted(rest: DataFrame, own: DataFrame) -> DataFrame:
    """The passages of `rest` with the earlier message that holds most of their sentences, and how many."""
    merged = own.groupBy("conv_id", "turn").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("h")))).alias("h"))
    merged = saved(_keyed(merged, "ca", "cb"), "merged")
    classes = merged.groupBy("conv_id", "ca", "cb").agg(F.min("turn").alias("least"), F.first("h").alias("h"))
    classes = classes.select("conv_id", "ca", "cb", "least", F.explode("h").alias("h"))
    asked = rest.groupBy("conv_id", "wa", "wb").agg(F.first("h").alias("h"), F.max("turn").alias("most")).select("conv_id", "wa", "wb", "most", F.explode("h").alias("h"))
    shared = asked.join(classes, ["conv_id", "h"]).where("least < most")
    votes = saved(shared.groupBy("conv_id", "wa", "wb", "ca", "cb", "least").agg(F.count("*").alias("hits")), "votes")
    by = ["conv_id", "wa", "wb", "turn"]
    open_votes = rest.select(*by).distinct().join(votes, ["conv_id", "wa", "wb"]).where("least < turn")
    best = open_votes.groupBy(*by).agg(F.max("hits").alias("most"))
    top = saved(open_votes.join(best, by).where("hits = most").select(*by, "ca", "cb", "hits"), "top")
    at = latest_before(merged, top, ["conv_id", "ca", "cb"])
    chosen = top.join(at, ["conv_id", "ca", "cb", "turn"]).groupBy(*by).agg(F.max("source").alias("source"), F.max("hits").alias("hits"))
    return rest.drop("source").join(chosen, by).select("conv_id", "turn", "passage", "level", "source", "hits")


def _spoken(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, h): the sentence hashes of each message's own text."""
    return messages.select("conv_id", "turn", F.array_sort(sentence_hashes(own_text(F.col("lines")))).alias("h")).where(F.size("h") > 0)


def _asked(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, passage, h): the sentence hashes of each passage."""
    each = messages.select("conv_id", "turn", F.posexplode(passages(F.col("lines"))).alias("passage", "p"))
    return each.select("conv_id", "turn", "passage", F.array_sort(sentence_hashes(F.col("p.body"))).alias("h"))


def reply_links(messages: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Passages with their sources (conv_id, turn, passage, level, source, hits), and (conv_id, turn, reply_to).

    messages holds conv_id, turn and lines; conv_id is never null here. `known` holds their facts where they are written already. Passages are first looked
    up by their whole hashes; the sentences of those that are no whole message are hashed one by one, in a second reading.
    """
    messages = messages.where("turn is not null")
    known = saved(facts(messages), "facts") if known is None else known.where("turn is not null")
    own = known.select("conv_id", "turn", "whole.*").where("n > 0")
    quoted = known.select("conv_id", "turn", F.posexplode("quoted").alias("passage", "p")).select("conv_id", "turn", "passage", "p.level", "p.w.*").where("n > 0")
    whole = latest_before(own, quoted, ["conv_id", "wa", "wb"])
    met = saved(quoted.join(whole, ["conv_id", "wa", "wb", "turn"], "left"), "met")
    hits = met.where("source is not null").select("conv_id", "turn", "passage", "level", "source", F.col("n").alias("hits"))
    rest = met.where("source is null").drop("n")
    if not rest.isEmpty():
        open_rows = rest.join(_asked(messages).dropDuplicates(["conv_id", "turn", "passage", "h"]), ["conv_id", "turn", "passage"])
        # Of several rows of one turn, the passage whose hash is asked for counts.
        open_rows = open_rows.where((F.xxhash64("h") == F.col("wa")) & (F.xxhash64(F.lit("m"), "h") == F.col("wb")))
        hits = hits.unionByName(_voted(saved(open_rows, "open"), _spoken(messages)))
    best = hits.groupBy("conv_id", "turn", "passage", "level").agg(F.max(F.struct("hits", "source")).alias("best"))
    linked = saved(best.select("conv_id", "turn", "passage", "level", "best.source", "best.hits"), "passages")
    outer = linked.groupBy("conv_id", "turn").agg(F.max(F.struct(-F.col("level"), F.col("hits"), F.col("source"))).alias("best"))
    return linked, outer.select("conv_id", "turn", F.col("best.source").alias("reply_to"))


def thread_depths(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, root, depth) of the messages that reply to one, by pointer doubling: log2(longest chain) rounds.

    Only rows whose pointer still leads to a reply take part in a round, so that short chains settle early.
    """
    settled = None
    active = saved(replies.select("conv_id", "turn", F.col("reply_to").alias("root"), F.lit(1).cast("long").alias("depth")), "pointers")
    for _ in range(MAX_DOUBLINGS):
        known = active if settled is None else active.unionByName(settled)
        up = known.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        step = active.join(up, ["conv_id", "root"], "left")
        step = saved(step.select("conv_id", "turn", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")), "pointers")
        done, active = step.where("not moved").drop("moved"), step.where("moved").drop("moved")
        settled = done if settled is None else settled.unionByName(done)
        if active.isEmpty():
            return settled
    raise RuntimeError("reply chains did not settle")


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """rows with their number (from 0) within `group`, by a range-partitioned sort and counts for each partition."""
    ranged = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    part, row = F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    held = saved(ranged.select("*", part.alias("_part"), row.alias("_row")), "ranged")
    counts = held.groupBy("_part").agg(F.count("*").alias("_n"))  # one row for each partition
    before = saved(counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before")), "offsets")
    at = held.join(before, "_part").withColumn("_at", F.col("_before") + F.col("_row"))
    least = at.groupBy(group).agg(F.min("_at").alias("_least"))
    return at.join(least, group).select(*rows.columns, (F.col("_at") - F.col("_least")).alias(name))


def conversations(messages: DataFrame) -> DataFrame:
    """One row per row: conv_id, turn, role, text without quotes, n_quotes, reply_to, root, depth and position.

    Texts are written once, without their quotes; all that links and orders them are hashes and numbers, which meet the texts by row at the end.
    """
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    rows = messages.select(key.alias("_conv"), F.col("conv_id").alias("_id"), "turn", "role", parsed(F.coalesce("text", F.lit(""))).alias("lines"))
    lines = rows.select(F.col("_conv").alias("conv_id"), "turn", "lines")
    held = saved(facts(rows.withColumnRenamed("_conv", "conv_id")).withColumn("_of_row", F.monotonically_increasing_id()), "messages")
    linked, replies = reply_links(lines, held.select("conv_id", "turn", "whole", "quoted"))
    replies = saved(replies, "replies")
    by = ["conv_id", "turn"]
    parts = [replies, thread_depths(replies), linked.groupBy(*by).agg(F.count("*").alias("n_linked"))]
    # Rows of one turn follow each other by role and a hash of their text.
    plain = held.select(*by, "_of_row", "role", F.md5("own").alias("_text"), F.size("quoted").cast("long").alias("n_quotes"))
    joined = reduce(lambda a, b: a.join(b, by, "left"), parts, plain)
    full = joined.select(*by, "_of_row", "role", "_text", "n_quotes", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "reply_to", F.coalesce("root", "turn").alias("root"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"))
    placed = numbered(full, "conv_id", ["root", "depth", "turn", "role", "_text"], "position")
    texts = held.select("_of_row", "_id", F.col("own").alias("text"))
    return texts.join(placed, "_of_row").select(F.col("_id").alias("conv_id"), "turn", "role", "text", "n_quotes", "n_linked", "reply_to", "root", "depth", "position")


def as_mail(turns: DataFrame) -> DataFrame:
    """Conversations as a mail client sends them: each turn quotes the two before it, at levels one and two."""
    said = F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # One shuffle: each turn goes to the two after it, the first of its rows where it has several.
    sent = turns.select("conv_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("_back"), "turn", said.alias("_m")).select("conv_id", (F.col("turn") + F.col("_back")).alias("turn"), "_back", "_m")
    before = sent.groupBy("conv_id", "turn").agg(*[F.min(F.when(F.col("_back") == n, F.col("_m"))).alias(f"m{n}") for n in (1, 2)])
    joined = turns.join(before, ["conv_id", "turn"], "left").select("conv_id", "turn", "role", "text", F.col("m1.role").alias("role1"), F.col("m1.text").alias("text1"), F.col("m2.text").alias("text2"))
    marked = lambda text, mark: F.concat(F.lit(mark), F.replace(text, F.lit("\n"), F.lit("\n" + mark)))
    head = F.concat(F.lit("On turn "), (F.col("turn") - 1).cast("string"), F.lit(", "), F.col("role1"), F.lit(" wrote:"))
    mail = F.concat_ws("\n", F.when(F.col("text1").isNotNull(), head), marked(F.col("text1"), "> "), marked(F.col("text2"), ">> "), F.coalesce("text", F.lit("")))
    return joined.select("conv_id", "turn", "role", mail.alias("text"))


#: conversations(as_mail(conversations)) in DuckDB: sentences are compared as texts, not by hash, and chains are walked.
SQL = rf"""
    WITH RECURSIVE said AS (SELECT conv_id, turn + back AS turn, back, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS m FROM conversations, (VALUES (1), (2)) b(back)),
    before AS (SELECT conv_id, turn, min(m) FILTER (back = 1) AS m1, min(m) FILTER (back = 2) AS m2 FROM said GROUP BY ALL),
    mail AS (
        SELECT row_number() OVER () AS id, coalesce(CAST(c.conv_id AS VARCHAR), '') AS conv, c.conv_id, c.turn, c.role,
               concat_ws(chr(10), CASE WHEN m1 IS NOT NULL THEN concat('On turn ', c.turn - 1, ', ', m1.role, ' wrote:') END,
                         '> ' || replace(m1.text, chr(10), chr(10) || '> '), '>> ' || replace(m2.text, chr(10), chr(10) || '>> '), coalesce(c.text, '')) AS text
        FROM conversations c LEFT JOIN before b ON b.conv_id = c.conv_id AND b.turn = c.turn),
    cut AS (SELECT id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM mail),
    marked AS (SELECT id, i, line, starts_with(ltrim(line, ' ' || chr(9)), '>') AS quoted FROM cut),
    levels AS (
        SELECT id, i, CASE WHEN quoted THEN length(regexp_replace(regexp_extract(line, '{MARKS}', 1), '[^>]', '', 'g')) ELSE 0 END AS level,
               CASE WHEN quoted THEN regexp_replace(line, '{MARKS}', '') ELSE line END AS body FROM marked),
    near AS (SELECT *, coalesce(lead(level) OVER w, 0) AS following, level IS DISTINCT FROM lag(level) OVER w AS starts FROM levels WINDOW w AS (PARTITION BY id ORDER BY i)),
    own AS (
        SELECT id, trim(coalesce(string_agg(body, chr(10) ORDER BY i) FILTER (level = 0 AND NOT (following > 0 AND regexp_matches(body, '{ATTRIBUTION}'))), ''), chr(10) || chr(13)) AS text
        FROM near GROUP BY id),
    runs AS (SELECT *, CAST(sum(CAST(starts AND level > 0 AS INT)) OVER (PARTITION BY id ORDER BY i) - 1 AS BIGINT) AS passage FROM near),
    passages AS (SELECT id, passage, level, string_agg(body, chr(10) ORDER BY i) AS text FROM runs WHERE level > 0 GROUP BY id, passage, level),
    texts AS (SELECT id, CAST(NULL AS BIGINT) AS passage, 0 AS level, text FROM own UNION ALL SELECT * FROM passages),
    plain AS (
        SELECT id, passage, level,
               regexp_replace(regexp_replace(regexp_replace(lower(text), '[ \t\n\x0B\f\r]+', ' ', 'g'), '([.!?]) ', '\1' || chr(10), 'g'), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') AS text FROM texts),
    pieces AS (SELECT id, passage, level, trim(unnest(string_split(text, chr(10)))) AS s FROM plain),
    sets AS (
        SELECT conv, turn, passage, level, list_sort(list(DISTINCT s)) AS whole, count(DISTINCT s) AS n
        FROM pieces JOIN mail USING (id) WHERE s <> '' AND turn IS NOT NULL GROUP BY conv, turn, id, passage, level),
    asked AS (SELECT DISTINCT * FROM sets WHERE passage IS NOT NULL),
    found AS (
        SELECT a.*, (SELECT max(o.turn) FROM sets o WHERE o.passage IS NULL AND o.conv = a.conv AND o.whole = a.whole AND o.turn < a.turn) AS source FROM asked a),
    sentences AS (SELECT DISTINCT conv, turn, unnest(whole) AS s FROM sets WHERE passage IS NULL),
    rest AS (SELECT conv, turn, passage, level, whole, unnest(whole) AS s FROM found WHERE source IS NULL),
    votes AS (
        SELECT r.conv, r.turn, r.passage, r.level, r.whole, o.turn AS source, count(*) AS hits
        FROM rest r JOIN sentences o ON o.conv = r.conv AND o.s = r.s AND o.turn < r.turn GROUP BY ALL),
    hits AS (
        SELECT conv, turn, passage, level, source, n AS hits FROM found WHERE source IS NOT NULL
        UNION ALL SELECT conv, turn, passage, level, source, hits FROM votes),
    linked AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY conv, turn, passage, level ORDER BY hits DESC, source DESC) = 1),
    replies AS (
        SELECT conv, turn, source AS reply_to, count(*) OVER (PARTITION BY conv, turn) AS n_linked FROM linked
        QUALIFY row_number() OVER (PARTITION BY conv, turn ORDER BY level, hits DESC, source DESC) = 1),
    chain AS (
        SELECT conv, turn, reply_to AS root, 1 AS depth FROM replies
        UNION ALL SELECT c.conv, c.turn, r.reply_to, c.depth + 1 FROM chain c JOIN replies r ON r.conv = c.conv AND r.turn = c.root),
    roots AS (SELECT conv, turn, arg_max(root, depth) AS root, max(depth) AS depth FROM chain GROUP BY conv, turn),
    placed AS (
        SELECT m.conv, m.conv_id, m.turn, m.role, o.text, (SELECT count(*) FROM passages p WHERE p.id = m.id) AS n_quotes,
               coalesce(n_linked, 0) AS n_linked, reply_to, coalesce(root, m.turn) AS root, coalesce(depth, 0) AS depth
        FROM mail m JOIN own o USING (id) LEFT JOIN replies r ON r.conv = m.conv AND r.turn = m.turn LEFT JOIN roots t ON t.conv = m.conv AND t.turn = m.turn)
    SELECT conv_id, turn, role, text, CAST(n_quotes AS BIGINT) AS n_quotes, CAST(n_linked AS BIGINT) AS n_linked, reply_to, root, CAST(depth AS BIGINT) AS depth,
           row_number() OVER (PARTITION BY conv ORDER BY root NULLS FIRST, depth, turn NULLS FIRST, role NULLS FIRST, md5(text)) - 1 AS position
    FROM placed"""
