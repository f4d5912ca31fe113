"""Op 9: chat formatting after cumulative-snapshot collapse.

Chat logs often hold one conversation many times: a snapshot after every turn. A rolling hash of the
turn prefix (two 64-bit halves; every turn adds a hash of its place, role and text) identifies each
prefix; conversations whose whole hash is a proper prefix of another are removed by an anti-join, and
of equal conversations the least id stays. The others are rendered turn by turn with a chat template.

A conversation may hold a third of all turns, so none is gathered: turns are range-sorted by
(conversation, turn), numbered across partitions, and rolling hashes and offsets are differences of
running values along that order. Prefixes are made distinct before the anti-join, so a first turn
that many conversations share is one row.

Defined results: turns are ordered by turn (nulls first), then role, then text; repeated rows are
turns of their own; a null role renders as an empty one and a null text as empty, but null and empty
differ in the hash; rows with a null conv_id are one conversation, whose id is less than any other; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roamer.llm.common import cut, register, table

TEMPLATE = ("<|im_start|>", "\n", "<|im_end|>\n")


def _running(df: DataFrame, values: dict[str, str], fold: str) -> DataFrame:
    """Running folds (``sum`` or ``bit_xor``) of columns along the whole order of ``__at``: within
    each partition by a window, across partitions by one row a partition."""
    inner = {f"{out}": F.expr(f"{fold}({c}) over (partition by __p order by __at rows between unbounded preceding and current row)") for out, c in values.items()}
    part = df.groupBy("__p").agg(*[F.expr(f"{fold}({c})").alias(f"__t_{out}") for out, c in values.items()])
    before = part.select("__p", *[F.expr(f"coalesce({fold}(__t_{out}) over (order by __p rows between unbounded preceding and 1 preceding), 0L)").alias(f"__b_{out}") for out in values])
    join = (lambda a, b: F.col(a) + F.col(b)) if fold == "sum" else (lambda a, b: F.col(a).bitwiseXOR(F.col(b)))
    wide = df.withColumns(inner).join(F.broadcast(before), "__p")
    return wide.withColumns({out: join(out, f"__b_{out}") for out in values}).drop(*[f"__b_{out}" for out in values])


def ordered_turns(chats: DataFrame) -> DataFrame:
    """Materialised turns in order; __at is unique and ascending, __p its partition."""
    keys = ["conv_id", "turn", "role", "text"]
    rows = chats.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    at = F.monotonically_increasing_id()
    return cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys)).withColumn("__at", at).withColumn("__p", F.shiftright("__at", 33))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(__at, conv_id, pos, n, h1, h2): each turn's place, its conversation's length, and the hash of
    the conversation's turns up to it."""
    one = F.lit(1).cast("long")
    light = turns.select("__at", "__p", "conv_id", one.alias("__one"),
                         F.xxhash64(F.lit(1), F.col("role").isNull(), "role", F.col("text").isNull(), "text").alias("__a"),
                         F.xxhash64(F.lit(2), F.col("text").isNull(), "text", F.col("role").isNull(), "role").alias("__b"))
    placed = _running(light, {"g": "__one"}, "sum")
    size = placed.groupBy(F.col("conv_id").alias("__c")).agg(F.min("g").alias("__first"), F.count("*").alias("n"))
    placed = placed.join(size, F.col("conv_id").eqNullSafe(F.col("__c"))).withColumn("pos", F.col("g") - F.col("__first")).drop("__c")
    mixed = cut(placed.select("__at", "__p", "conv_id", "pos", "n", F.xxhash64(F.lit(3), "pos", "__a").alias("x1"), F.xxhash64(F.lit(4), "pos", "__b").alias("x2")))
    rolled = _running(mixed, {"h1": "x1", "h2": "x2"}, "bit_xor")
    # What the order held before the conversation began.
    base = rolled.filter("pos = 0").select(F.col("conv_id").alias("__c"), F.col("h1").bitwiseXOR(F.col("x1")).alias("__h1"), F.col("h2").bitwiseXOR(F.col("x2")).alias("__h2"))
    return rolled.join(base, F.col("conv_id").eqNullSafe(F.col("__c"))).select(
        "__at", "conv_id", "pos", "n", F.col("h1").bitwiseXOR(F.col("__h1")).alias("h1"), F.col("h2").bitwiseXOR(F.col("__h2")).alias("h2"))


def maximal_conversations(hashes: DataFrame) -> DataFrame:
    """(conv_id, n) of conversations that are no snapshot of another; of equal ones the least id."""
    whole = hashes.filter("pos = n - 1").groupBy(F.col("n").alias("len"), "h1", "h2").agg(F.min(F.struct(F.col("conv_id").isNotNull().alias("k"), "conv_id")).alias("c"))
    proper = hashes.filter("pos < n - 1").select((F.col("pos") + 1).alias("len"), "h1", "h2").distinct()
    return whole.join(proper, ["len", "h1", "h2"], "left_anti").select(F.col("c.conv_id").alias("conv_id"), F.col("len").alias("n_turns"))


def format_chats(chats: DataFrame, template: tuple[str, str, str] = TEMPLATE) -> DataFrame:
    """A row a turn of the maximal conversations: conv_id, position, n_turns, role, rendered, start
    (UTF-8 bytes of the conversation before it). Joined in order, the rendered turns are the sample."""
    turns = ordered_turns(chats)
    hashes = cut(prefix_hashes(turns))
    kept = maximal_conversations(hashes).select(F.col("conv_id").alias("__c"), "n_turns")
    places = hashes.join(kept, F.col("conv_id").eqNullSafe(F.col("__c"))).select("__at", "pos", "n_turns")
    open_, middle, close = template
    text = F.concat(F.lit(open_), F.coalesce("role", F.lit("")), F.lit(middle), F.coalesce("text", F.lit("")), F.lit(close))
    rendered = turns.join(places, "__at").withColumn("rendered", text).withColumn("__size", F.octet_length("rendered").cast("long"))
    rendered = cut(rendered.select("__at", "__p", "conv_id", "pos", "n_turns", "role", "rendered", "__size"))
    sums = _running(rendered.select("__at", "__p", "conv_id", "pos", "__size"), {"upto": "__size"}, "sum").select("__at", "conv_id", "pos", (F.col("upto") - F.col("__size")).alias("before"))
    first = sums.filter("pos = 0").select(F.col("conv_id").alias("__c"), F.col("before").alias("__first"))
    starts = sums.join(first, F.col("conv_id").eqNullSafe(F.col("__c"))).select("__at", (F.col("before") - F.col("__first")).alias("start"))
    return rendered.join(starts, "__at").select("conv_id", F.col("pos").alias("position"), "n_turns", "role", "rendered", "start")


def _sql() -> str:
    open_, middle, close = (x.replace("\n", "' || chr(10) || '") for x in TEMPLATE)
    return f"""
    WITH t AS (SELECT conv_id, role, text, row_number() OVER w - 1 AS position, count(*) OVER (PARTITION BY conv_id) AS n_turns,
                      md5(coalesce('r' || role, 'n') || chr(1) || coalesce('t' || text, 'n')) AS m FROM conversations
               WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)),
    p AS (SELECT *, string_agg(m, '') OVER (PARTITION BY conv_id ORDER BY position) AS h FROM t),
    whole AS (SELECT h, min(conv_id) AS conv_id FROM p WHERE position = n_turns - 1 GROUP BY h),
    kept AS (SELECT conv_id FROM whole WHERE h NOT IN (SELECT h FROM p WHERE position < n_turns - 1)),
    r AS (SELECT conv_id, position, n_turns, role, '{open_}' || coalesce(role, '') || '{middle}' || coalesce(text, '') || '{close}' AS rendered
          FROM t WHERE conv_id IN (SELECT conv_id FROM kept))
    SELECT *, cast(coalesce(sum(strlen(rendered)) OVER (PARTITION BY conv_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM r"""


@register("op9_chat_snapshots", _sql())
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))
