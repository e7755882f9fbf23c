"""Corpora composed from the test tables.

The tables hold no SQL text, so statements are put together from their rows: each
row picks a statement shape and fills in its own values. All rows of the table
take part, so a corpus grows with its table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spots import sealed


@dataclass(frozen=True)
class Shape:
    """``fields``: raw field name -> text; ``<X>`` in a text stands for a value of the row."""

    fields: dict[str, str]


def _q(question: str, sql: str, qf: str = "question", sf: str = "sql", **more: str) -> Shape:
    return Shape({qf: question, sf: sql, **more})


# <T> event type, <V> amount with two decimals, <N> a number of two digits
EVENT_SHAPES = [
    _q("List the users who had a <T> event", "SELECT user_id FROM events WHERE event_type = '<T>'", db_id="shop"),
    _q(
        "How many events of each type have a value of at least <V>?",
        "SELECT event_type, COUNT(*) FROM events WHERE value >= <V> GROUP BY event_type ORDER BY COUNT(*) DESC LIMIT 5",
        "prompt",
        "query",
        db="shop",
    ),
    _q(
        "Which customers had a <T> event?",
        "SELECT u.c_name FROM customer u JOIN events e ON u.c_custkey = e.user_id WHERE e.event_type IN ('<T>','zz')",
        "nl",
        "gold_sql",
        schema="crm",
    ),
    _q("Show every user with an event", "SELECT user_id FROM events GROUP BY user_id", "instruction", "gold", origin="log"),
    _q("Return the <N> smallest events by value", "SELECT event_id, value FROM events ORDER BY value LIMIT <N>", "question", "pred_sql"),
    _q("What happened?", ""),
    _q("Show all events in the table", "SELECT * FROM events"),
    _q("hi", "SELECT user_id FROM events WHERE event_type = '<T>'"),
    Shape({}),
    _q("Archive the events with a value below <V>", "UPDATE events SET event_type = 'archived' WHERE value < <V>"),
]
BROKEN_LINE = '{"question": "broken'

# <P> order priority, <A> amount, <D> date, <C> customer, <S> status letter, <N> two digits
ORDER_SHAPES = [
    _q("What are the names of all customers?", "SELECT c_name FROM customer"),
    _q("Find orders of more than <A>", "SELECT * FROM orders WHERE total > <A>"),
    _q(
        "How many orders does each city have?",
        "SELECT c.city, COUNT(*) FROM orders o JOIN customers c ON o.cust_id = c.id WHERE c.segment = 'active' "
        "AND o.total >= <A> GROUP BY c.city HAVING COUNT(*) > <N> ORDER BY COUNT(*) DESC LIMIT 5",
    ),
    _q(
        "Show the customers whose priority contains a given text, the oldest three only please",
        "SELECT name, age FROM customer WHERE priority LIKE '%<P>%' ORDER BY age LIMIT 3",
    ),
    _q("Count the sales of one year", "SELECT COUNT(*) FROM sales WHERE year = '<Y>'"),
    _q("Which orders have this date?", "SELECT o_key FROM orders WHERE o_date IN ('<D>','<D>')"),
    _q("List the different countries", "SELECT DISTINCT country FROM customer WHERE age BETWEEN <N> AND <C>"),
    _q(
        "List customers without an order",
        "SELECT name FROM customer WHERE cust_id NOT IN (SELECT cust_id FROM orders)",
    ),
    _q(
        "Return customer names by order, last first",
        "SELECT s.name FROM customer AS s LEFT JOIN orders AS e ON s.id=e.cid ORDER BY s.name DESC",
    ),
    _q("Close the accounts below zero", "UPDATE accounts SET status = 'closed' WHERE balance <= <C>"),
    _q("Show page <N> of the parts", "SELECT a, b, c FROM part LIMIT 10 OFFSET <N>"),
    _q("Add an order", "INSERT INTO orders (o_key, o_prio) VALUES (<C>, '<P>')"),
    _q("Remove old orders", "DELETE FROM orders WHERE o_date < '<D>' AND flag = '<S>'"),
    _q("Create the log table", "CREATE TABLE log (id INT AUTO_INCREMENT, ok BOOLEAN, n TINYINT(1))"),
    _q("Drop the log", "DROP TABLE log"),
    _q(
        "What is the average, maximum and total amount per status and year?",
        "SELECT status, AVG(total), MAX(total), SUM(total) FROM orders WHERE note LIKE 'x%' GROUP BY status, YEAR(o_date), o.kind ORDER BY status ASC",
    ),
    _q(
        "Orders of the last days",
        "SELECT o_key, LENGTH(note) FROM orders WHERE o_date > DATE_ADD(CURDATE(), INTERVAL <N> DAY) AND made < NOW()",
    ),
    _q(
        "Top customers with their orders",
        "WITH t AS (SELECT cid FROM orders) SELECT cid FROM t RIGHT JOIN customer ON cid = customer.id",
    ),
]


def scan(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt over the session's shuffle partitions: a test table is one file of one row group, so one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _pick(shape: Column, texts: list[str | None]) -> Column:
    """The shape's text; null where the shape has none."""
    return F.element_at(F.array(*[F.lit(t).cast("string") for t in texts]), (shape + 1).cast("int"))


def _fill(text: Column, values: dict[str, Column]) -> Column:
    for mark, value in values.items():
        text = F.replace(text, F.lit(mark), value)
    return text


def _compose(df: DataFrame, ord_col: Column, shapes: list[Shape], values: dict[str, Column], *keep: str) -> DataFrame:
    names = list(dict.fromkeys(f for s in shapes for f in s.fields))
    shape = F.pmod(ord_col, F.lit(len(shapes)))
    composed = df.select(
        ord_col.cast("long").alias("ord"),
        *keep,
        *[_fill(_pick(shape, [s.fields.get(f) for s in shapes]), values).alias(f) for f in names],
    )
    return sealed(composed, *names)  # to the plans above it is a scan


def money(c: str) -> Column:
    return F.col(c).cast("decimal(12,2)").cast("string")


def event_records(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Raw records from ``events``: ord, ts and the raw fields (null = field absent)."""
    events = dealt(scan(spark, sf_dir, "events")) if events is None else events
    number = (F.pmod(F.col("event_id"), F.lit(90)) + 10).cast("string")
    values = {"<T>": F.col("event_type"), "<V>": money("value"), "<N>": number}
    return _compose(events, F.col("event_id"), EVENT_SHAPES, values, "ts")


def event_lines(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """The same as JSON lines; the shape without fields is a broken line."""
    rec = event_records(spark, sf_dir, events)
    fields = [c for c in rec.columns if c not in ("ord", "ts")]
    broken = F.coalesce(*fields).isNull()
    line = F.when(broken, F.lit(BROKEN_LINE)).otherwise(F.to_json(F.struct(*fields)))
    return sealed(rec.select("ord", "ts", line.alias("value")), "value")


def order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records (question, sql) from ``orders``; the customer's segment is the database."""
    orders = dealt(scan(spark, sf_dir, "orders"))
    number = (F.pmod(F.col("o_orderkey"), F.lit(90)) + 10).cast("string")
    values = {
        "<P>": F.col("o_orderpriority"),
        "<A>": money("o_totalprice"),
        "<D>": F.date_format("o_orderdate", "yyyy-MM-dd"),
        "<Y>": F.date_format("o_orderdate", "yyyy"),
        "<C>": F.col("o_custkey").cast("string"),
        "<S>": F.col("o_orderstatus"),
        "<N>": number,
    }
    rec = _compose(orders, F.col("o_orderkey"), ORDER_SHAPES, values, "o_custkey")
    owner = scan(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.lower("c_mktsegment").alias("db_id")
    )
    return rec.join(owner, "o_custkey", "left").drop("o_custkey").withColumn("source", F.lit("orders"))


# JSON lines of every odd kind; <C> is the customer's key.
ODD_LINES = [
    '{"question":"How many are there of <C>?","sql":"SELECT a FROM t WHERE b = <C>"}',
    '{"question":<C>1,"sql":"SELECT a FROM t"}',
    "[<C>]",
    "<C>",
    "not json <C>",
    '{"question":"first","question":"last <C>","sql":"SELECT a FROM t"}',
    '{"question":"","prompt":"prompt <C>","sql":null,"query":"SELECT a FROM t LIMIT <C>"}',
    '{"question":false,"nl":"nl <C>","sql":[],"gold":"SELECT b FROM t"}',
    '{"question":"tail <C>","sql":"SELECT a FROM t"} tail',
    '{"question":"object <C>","sql":{"x":1}}',
    '  {"question":"  padded <C>  ","sql":"\\tSELECT a FROM t\\n","db_id":5,"source":true}  ',
    '{"question":"unread <C>"}',
    "",
    '{"question":0,"instruction":"zero <C>","sql":"SELECT a FROM t"}',
    '"text <C>"',
    '{"question":"open <C>", "sql":"SELECT',
]


def odd_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every odd kind, one per customer."""
    customers = dealt(scan(spark, sf_dir, "customer"))
    key = F.col("c_custkey")
    line = _fill(_pick(F.pmod(key, F.lit(len(ODD_LINES))), ODD_LINES), {"<C>": key.cast("string")})
    return customers.select(key.alias("ord"), line.alias("value"))
