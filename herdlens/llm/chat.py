"""Quotation linking: conversations in reply order, without the quotes.

Lines open with any number of ``>``: their quote depth. What a message quotes at
a depth, by line, paragraph and contiguous passage and as a whole, is normalised
and hashed, and joined to the first message of the conversation that says it
itself (one row per hash, so a line said a thousand times joins once). Lines of
a paragraph are joined, so a mail program may have wrapped them anew. A message answers the earlier message
of which it quotes most at its lowest linked depth. Threads are followed to
their first message by pointer jumping, and messages are numbered in reply
order: thread by thread, each in order of turn. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herdlens.llm.common import ranked, stored, text_of

_QUOTE = r"^((?:[ \t]*>)+)"
#: The line that leads in a quote.
_LEAD = r"^\s*(?:On\b.*\bwrote|.*\bschrieb|Le\b.*\ba écrit|El\b.*\bescribió)\s*:\s*$"


def _depth(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _QUOTE, 1), "[^>]", ""))


def _plain(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")))


def _units(plain: Column, kinds: Column, kind: Column) -> Column:
    """Hashes of the normalised lines of a kind, of their paragraphs and contiguous passages, and of all of them together."""
    mine = lambda i: F.get(kinds, i) == kind
    lines = F.filter(plain, lambda x, i: (x != "") & mine(i))

    def joined(parts: Column) -> Column:
        # A normalised line holds no line break, which stands for what is in between.
        return F.filter(F.transform(F.split(F.array_join(parts, " "), "\n"), lambda x: F.trim(x)), lambda x: x != "")

    paragraphs = joined(F.transform(plain, lambda x, i: F.when((x != "") & mine(i), x).otherwise("\n")))
    passages = joined(F.filter(F.transform(plain, lambda x, i: F.when(mine(i), x).otherwise("\n")), lambda x: x != ""))
    whole = F.filter(F.array(F.array_join(lines, " ")), lambda x: x != "")
    return F.transform(F.array_distinct(F.concat(lines, paragraphs, passages, whole)), lambda x: F.md5(x))


def parsed(messages: DataFrame, text: str = "text") -> DataFrame:
    """``messages`` with ``_said`` (own lines), ``_depths``, ``_lines`` and ``_kinds`` (0 own, -1 leading in a quote, else the depth)."""
    rows = messages.withColumn("_lines", F.split(text_of(messages, text), "\n", -1))
    rows = rows.withColumn("_depths", F.transform("_lines", _depth))
    following = lambda i: F.coalesce(F.get("_depths", i + 1), F.lit(0))
    lead = lambda x, i: x.rlike(_LEAD) & (following(i) > 0)
    rows = rows.withColumn("_kinds", F.transform("_lines", lambda x, i: F.when((F.get("_depths", i) == 0) & lead(x, i), -1).otherwise(F.get("_depths", i))))
    return rows.withColumn("_said", F.filter("_lines", lambda x, i: F.get("_kinds", i) == 0))


def replies(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """(conv, turn, parent): the earlier message each linked message answers."""
    rows = parsed(messages.where(F.col(turn).isNotNull()), text)
    # A null conversation is one of its own.
    place = F.coalesce(F.concat(F.lit("c"), F.col(conv).cast("string")), F.lit("n"))
    rows = rows.select(place.alias("conv"), F.col(turn).cast("long").alias("turn"), "_kinds",
                       F.transform("_lines", lambda x: _plain(F.regexp_replace(x, _QUOTE, ""))).alias("_plain"))
    plain, kinds = F.col("_plain"), F.col("_kinds")
    at = F.explode(F.array_distinct(F.filter(kinds, lambda d: d > 0)))
    quoted = stored(rows.withColumn("depth", at).select("conv", "turn", "depth", F.explode(_units(plain, kinds, F.col("depth"))).alias("unit")),
                    "chat-quoted")
    # What a conversation without any quote says is linked with nothing.
    quoting = quoted.select("conv").distinct()
    said = (rows.join(quoting, "conv", "left_semi").select("conv", "turn", F.explode(_units(plain, kinds, F.lit(0))).alias("unit")))
    first = stored(said.groupBy("conv", "unit").agg(F.min("turn").alias("origin")), "chat-said")
    linked = quoted.join(first, ["conv", "unit"]).where("origin < turn")
    votes = linked.groupBy("conv", "turn", "depth", "origin").agg(F.count(F.lit(1)).alias("n"))
    best = F.max(F.struct((-F.col("depth")).alias("d"), "n", "origin"))
    return votes.groupBy("conv", "turn").agg(best.alias("b")).select("conv", "turn", F.col("b.origin").alias("parent"))


def roots(edges: DataFrame) -> DataFrame:
    """(conv, turn, parent, root): each linked message's thread, by pointer jumping over stored tables."""
    now = stored(edges.withColumn("root", F.col("parent")), "chat-roots")
    while True:
        up = now.select("conv", F.col("turn").alias("root"), F.col("root").alias("higher"))
        up = stored(now.join(up, ["conv", "root"], "left").withColumn("moved", F.col("higher").isNotNull())
                    .select("conv", "turn", "parent", F.coalesce("higher", "root").alias("root"), "moved"), "chat-roots")
        if up.where("moved").isEmpty():
            return up.drop("moved")
        now = up.drop("moved")


def reply_order(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """``messages`` with ``text`` free of quotes and with ``_parent``, ``_root``, ``_n_quoted``, ``_depth`` and ``_message_no``.

    Null text is empty; a null turn comes last and links to nothing; repeated
    rows of a turn share its link; ties in the order are broken by role and
    text. ``_message_no`` counts from 0 in each conversation.
    """
    links = roots(replies(messages, conv, turn, text)).select(F.col("conv").alias("_conv"), F.col("turn").alias("_turn"), F.col("parent").alias("_parent"), F.col("root").alias("_root"))
    rows = parsed(messages, text).withColumn("_key", F.coalesce(F.concat(F.lit("c"), F.col(conv).cast("string")), F.lit("n")))
    rows = rows.join(links, (F.col("_key") == F.col("_conv")) & (F.col(turn).cast("long") == F.col("_turn")), "left")
    rows = rows.select(*[F.array_join("_said", "\n").alias(c) if c == text else F.col(c) for c in messages.columns], "_key", "_parent",
                       F.coalesce("_root", F.col(turn).cast("long")).alias("_root"),
                       F.size(F.filter("_depths", lambda d: d > 0)).cast("long").alias("_n_quoted"), F.array_max("_depths").alias("_depth"))
    # Conversations, threads and turns follow each other in one range-partitioned order.
    others = [F.col(c).asc_nulls_last() for c in ("_root", turn)]
    rest = [F.col(c) for c in messages.columns if c not in (conv, turn)]
    placed = ranked(rows, [F.col("_key"), *others, *rest], "chat-order", "_position")
    start = stored(placed.groupBy("_key").agg(F.min("_position").alias("_start")), "chat-start")
    return (placed.join(start, "_key").withColumn("_message_no", F.col("_position") - F.col("_start"))
            .drop("_key", "_position", "_start"))


def op7_query(messages: DataFrame) -> DataFrame:
    out = reply_order(messages.select("conv_id", "turn", "role", "text"))
    return out.select("conv_id", "turn", "role", F.col("_parent").alias("parent_turn"), F.col("_root").alias("root_turn"),
                      F.col("_n_quoted").alias("n_quoted"), F.col("_message_no").alias("message_no"), "text")


_SQL_PLAIN = r"lower(trim(regexp_replace({}, '[\x20\x09-\x0D]+', ' ', 'g'), ' '))"

OP7_SQL = rf"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS id, conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) AS ls FROM conversations),
l AS (SELECT id, conv_id, turn, pos, ls[pos] AS line, length(regexp_replace(regexp_extract(ls[pos], '^((?:[ \t]*>)+)', 1), '[^>]', '', 'g')) AS depth,
             coalesce(length(regexp_replace(regexp_extract(ls[pos + 1], '^((?:[ \t]*>)+)', 1), '[^>]', '', 'g')), 0) AS next_depth
      FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS pos FROM m)),
c AS (SELECT *, depth = 0 AND NOT (regexp_matches(line, '{_LEAD}') AND next_depth > 0) AS own FROM l),
p AS (SELECT id, conv_id, turn, pos, CASE WHEN own THEN 0 ELSE depth END AS depth, {_SQL_PLAIN.format("regexp_replace(line, '^((?:[ \\t]*>)+)', '')")} AS unit FROM c WHERE own OR depth > 0),
g AS (SELECT *, pos - row_number() OVER (PARTITION BY id, depth ORDER BY pos) AS passage,
             CASE WHEN unit <> '' THEN pos - row_number() OVER (PARTITION BY id, depth, unit <> '' ORDER BY pos) END AS paragraph FROM p),
u AS (SELECT id, conv_id, turn, depth, unit FROM g WHERE unit <> ''
      UNION SELECT id, conv_id, turn, depth, string_agg(unit, ' ' ORDER BY pos) FROM g WHERE unit <> '' GROUP BY id, conv_id, turn, depth, paragraph
      UNION SELECT id, conv_id, turn, depth, string_agg(unit, ' ' ORDER BY pos) FROM g WHERE unit <> '' GROUP BY id, conv_id, turn, depth, passage
      UNION SELECT id, conv_id, turn, depth, string_agg(unit, ' ' ORDER BY pos) FROM g WHERE unit <> '' GROUP BY id, conv_id, turn, depth),
f AS (SELECT conv_id, unit, min(turn) AS origin FROM u WHERE depth = 0 AND turn IS NOT NULL GROUP BY conv_id, unit),
v AS (SELECT u.conv_id, u.turn, u.depth, f.origin, count(*) AS n FROM u JOIN f ON u.conv_id IS NOT DISTINCT FROM f.conv_id AND u.unit = f.unit
      WHERE u.depth > 0 AND f.origin < u.turn GROUP BY ALL),
e AS (SELECT conv_id, turn, origin AS parent FROM v
      QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY depth, n DESC, origin DESC) = 1),
r AS (SELECT conv_id, turn, parent AS root FROM e UNION ALL
      SELECT r.conv_id, r.turn, e.parent FROM r JOIN e ON r.conv_id IS NOT DISTINCT FROM e.conv_id AND r.root = e.turn),
t AS (SELECT conv_id, turn, min(root) AS root FROM r GROUP BY conv_id, turn),
s AS (SELECT id, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE own) AS text, count(*) FILTER (WHERE depth > 0) AS n_quoted FROM c GROUP BY id),
o AS (SELECT m.id, m.conv_id, m.turn, m.role, e.parent AS parent_turn, coalesce(t.root, m.turn) AS root_turn, s.n_quoted, coalesce(s.text, '') AS text
      FROM m JOIN s ON m.id = s.id LEFT JOIN e ON m.conv_id IS NOT DISTINCT FROM e.conv_id AND m.turn = e.turn
      LEFT JOIN t ON m.conv_id IS NOT DISTINCT FROM t.conv_id AND m.turn = t.turn)
SELECT conv_id, turn, role, parent_turn, root_turn, n_quoted,
       row_number() OVER (PARTITION BY conv_id ORDER BY root_turn NULLS LAST, turn NULLS LAST, role NULLS FIRST, text) - 1 AS message_no, text FROM o
"""
