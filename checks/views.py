"""Tables with known defects, derived from the test tables.

Each view is one SQL text that runs on Spark and, with :func:`portable`, on DuckDB.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    # 30% and 60% missing, zeros, outliers, a constant, 4% repeated rows
    "dirty_base": """
        SELECT o_orderkey,
          CASE WHEN o_orderkey % 10 < 3 THEN NULL ELSE o_custkey END AS o_custkey,
          CASE WHEN o_orderkey % 20 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
          CASE WHEN o_orderkey % 10 < 6 THEN NULL ELSE o_orderpriority END AS o_orderpriority,
          CASE WHEN o_orderkey % 97 = 0 THEN o_totalprice * 100
               WHEN o_orderkey % 7 = 0 THEN CAST(0 AS DOUBLE) ELSE o_totalprice END AS o_totalprice,
          'FIXED' AS constant_col, o_orderkey % 2 = 0 AS is_even, o_orderdate
        FROM orders
    """,
    "dirty_orders": """
        SELECT * FROM dirty_base
        UNION ALL SELECT * FROM dirty_base WHERE o_orderkey % 25 = 0
    """,
    "very_dirty_orders": """
        SELECT * FROM dirty_base
        UNION ALL SELECT * FROM dirty_base WHERE o_orderkey % 10 = 0
    """,
    "web_log": """
        SELECT event_id,
          CASE WHEN event_id % 50 = 0 THEN 'not-an-ip'
               ELSE CONCAT('10.0.', CAST(user_id % 7 AS STRING), '.', CAST(user_id AS STRING))
               END AS ip,
          ts AS timestamp,
          CASE WHEN event_type = 'view' THEN 'GET' ELSE 'POST' END AS method,
          CONCAT('/', event_type) AS endpoint,
          CASE WHEN event_id % 200 = 0 THEN 999 WHEN event_id % 40 = 1 THEN 500
               WHEN event_id % 90 = 2 THEN 503 ELSE 200 END AS status,
          CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS size
        FROM events
    """,
    "log_lines": """
        SELECT event_id,
          CASE WHEN event_id % 37 = 0 THEN 'corrupt line'
          ELSE concat(ip, ' - - [', LOG_TIME(timestamp), ' +0000] "', method, ' ', endpoint,
            ' HTTP/1.1" ', cast(status AS string), ' ',
            CASE WHEN size IS NULL THEN '-'
                 ELSE cast(cast(floor(size) AS bigint) AS string) END,
            CASE WHEN event_id % 2 = 0 THEN ' "-" "agent"' ELSE '' END) END AS value
        FROM web_log
    """,
    "nginx_lines": """
        SELECT event_id,
          CASE WHEN event_id % 41 = 0 THEN 'cut off "GET'
          ELSE concat(ip, ' - - [', LOG_TIME(timestamp), ' +0000] "', method, ' ', endpoint,
            ' HTTP/2.0" ', cast(status AS string), ' ',
            cast(cast(floor(coalesce(size, 0)) AS bigint) AS string),
            ' "http://ref/', cast(event_id AS string), '" "',
            CASE WHEN event_id % 3 = 0 THEN '' ELSE 'agent/1.0 (x)' END, '"') END AS value
        FROM web_log
    """,
    "csv_log_lines": """
        SELECT event_id,
          CASE WHEN event_id % 43 = 0 THEN 'truncated,-,-'
          ELSE concat(CASE WHEN event_id % 4 = 0 THEN '"' ELSE '' END,
            CASE WHEN event_id % 5 = 0 THEN 'fe80:0:0::7' ELSE '10.1.2.3' END,
            ',-,-,[', LOG_TIME(timestamp), ',+0000],""', method, '"",', endpoint,
            ',HTTP/1.1,', cast(status AS string), ',',
            CASE WHEN size IS NULL THEN '-'
                 ELSE cast(cast(floor(size) AS bigint) AS string) END,
            ',-,""agent ', cast(event_id % 3 AS string), '""',
            CASE WHEN event_id % 4 = 0 THEN '"' ELSE '' END) END AS value
        FROM web_log
    """,
    "syslog_lines": """
        SELECT event_id,
          CASE WHEN event_id % 31 = 0 THEN 'no record here'
          ELSE concat('Jan ', cast(1 + event_id % 28 AS string), ' 03:',
            cast(10 + event_id % 50 AS string), ':', cast(10 + event_id % 49 AS string),
            ' host', cast(user_id AS string), ' svc-', event_type,
            CASE WHEN event_id % 2 = 0 THEN concat('[', cast(user_id AS string), ']') ELSE '' END,
            ': did ', event_type, ': value ', cast(event_id AS string)) END AS value
        FROM events
    """,
    "decorated_lines": """
        SELECT event_id,
          CASE WHEN event_id % 12 = 0 THEN '======' WHEN event_id % 12 = 1 THEN '   '
               WHEN event_id % 12 = 2 THEN '# comment ' WHEN event_id % 12 = 3 THEN '[section]'
               WHEN event_id % 12 = 4 THEN 'Log  File opened'
               WHEN event_id % 12 = 5 THEN '"==> a,b,<=="'
               WHEN event_id % 12 = 6 THEN concat('""', value, '""')
               WHEN event_id % 12 = 7 THEN concat('  "', value, '" ')
               WHEN event_id % 12 = 8 THEN '"plain ""quoted"" text"'
               ELSE value END AS value
        FROM log_lines
    """,
    "json_lines": """
        SELECT event_id,
          CASE WHEN event_id % 11 = 0 THEN '{broken'
               WHEN event_id % 11 = 1 THEN '   '
               WHEN event_id % 11 = 2 THEN concat('{"k": 7, "name": "n', event_type, '"}')
               ELSE props END AS value
        FROM events
    """,
    "json_documents": """
        SELECT event_id,
          CASE WHEN event_id % 2 = 0
               THEN concat('[', props, ', {"k": 1000, "type": "', event_type, '"}]')
               ELSE props END AS value
        FROM events
    """,
    "ragged_lines": """
        SELECT event_id,
          CASE WHEN event_id % 5 = 0 THEN '  '
               WHEN event_id % 5 = 1 THEN event_type
               WHEN event_id % 5 = 2 THEN concat(event_type, '   ', cast(user_id AS string))
               ELSE concat(' ', event_type, ' ', cast(user_id AS string), ' x ',
                           cast(event_id AS string), ' ') END AS value
        FROM events
    """,
    "order_lines": '''
        SELECT o_orderkey,
          concat(cast(o_orderkey AS string), ',',
            CASE WHEN o_orderkey % 10 < 3 THEN 'NA' ELSE cast(o_custkey AS string) END, ',',
            CASE WHEN o_orderkey % 8 = 0 THEN '' WHEN o_orderkey % 8 = 1 THEN 'null'
                 ELSE cast(o_totalprice AS string) END, ',',
            CASE WHEN o_orderkey % 2 = 0 THEN 'True' ELSE 'false' END, ',"',
            o_orderpriority, ', ""', o_orderstatus, '"""',
            CASE WHEN o_orderkey % 50 = 7 THEN ',extra' WHEN o_orderkey % 50 = 8 THEN ',,'
                 ELSE concat(',', cast(cast(o_orderdate AS date) AS string)) END,
            CASE WHEN o_orderkey % 50 = 9 THEN ',more' ELSE '' END) AS value
        FROM orders
    ''',
    # eight "files" of different make, with junk lines among the first ones
    "mixed_lines": """
        SELECT concat('part-', cast(o_orderkey % 8 AS string),
                      CASE WHEN o_orderkey % 8 = 7 THEN '.json' ELSE '.txt' END) AS file,
          o_orderkey AS position,
          CASE WHEN o_orderkey >= 16 AND o_orderkey < 24 THEN '# comment line'
               WHEN o_orderkey >= 40 AND o_orderkey < 48 THEN ''
               WHEN o_orderkey < 8 AND o_orderkey % 8 < 3
                 THEN concat('key', d, 'customer', d, 'price', d, 'note')
               WHEN o_orderkey % 8 < 4
                 THEN concat(cast(o_orderkey AS string), d, cast(o_custkey AS string), d,
                             cast(o_totalprice AS string), d,
                             CASE WHEN o_orderkey % 3 = 0 THEN 'a,b' ELSE 'c' END)
               WHEN o_orderkey % 8 = 4
                 THEN concat('10.0.0.', cast(o_custkey % 250 AS string),
                             ' - - [05/Jan/2026:03:41:59 +0000] "GET /',
                             cast(o_orderkey AS string), ' HTTP/1.1" 200 17')
               WHEN o_orderkey % 8 = 5
                 THEN concat('{"id": ', cast(o_orderkey AS string), '}')
               WHEN o_orderkey % 8 = 6
                 THEN concat('ERROR [31/Jan/2026] at 10.0.0.1 code ', cast(o_custkey AS string))
               ELSE concat('{"id": ', cast(o_orderkey AS string), ', "n": [1]}') END AS value
        FROM (SELECT *, CASE WHEN o_orderkey % 8 = 0 THEN ',' WHEN o_orderkey % 8 = 1 THEN chr(9)
                             WHEN o_orderkey % 8 = 2 THEN '|' ELSE ';' END AS d
              FROM orders) AS keyed
    """,
    "damaged_orders": """
        SELECT o_orderkey,
          CASE WHEN o_orderkey % 13 = 0 THEN 'bad�cell'
               ELSE o_orderpriority END AS o_orderpriority,
          CASE WHEN o_orderkey % 29 = 0 THEN '�' ELSE o_orderstatus END AS o_orderstatus,
          o_totalprice
        FROM orders
    """,
    # numbers of every kind of trouble, as text
    "status_texts": """
        SELECT event_id,
          CASE WHEN event_id % 6 = 0 THEN '200' WHEN event_id % 6 = 1 THEN '999'
               WHEN event_id % 6 = 2 THEN 'abc' WHEN event_id % 6 = 3 THEN NULL
               WHEN event_id % 6 = 4 THEN '200.0' ELSE ' 404 ' END AS status,
          CASE WHEN event_id % 5 = 0 THEN '2024-01-05T10:11:12'
               WHEN event_id % 5 = 1 THEN 'yesterday'
               ELSE '2024-01-06T00:00:00' END AS timestamp,
          CASE WHEN event_id % 4 = 0 THEN value WHEN event_id % 4 = 1 THEN CAST('NaN' AS DOUBLE)
               WHEN event_id % 4 = 2 THEN CAST('Infinity' AS DOUBLE)
               ELSE -value END AS reading
        FROM events
    """,
}

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def _needed(text: str) -> list[str]:
    """Views used by a text, in the order in which they build on each other."""
    found: list[str] = []

    def visit(sql: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", sql) and name not in found:
                visit(VIEWS[name])
                if name not in found:
                    found.append(name)

    visit(text)
    return found


def portable(sql: str) -> str:
    """SQL over views as one DuckDB statement."""
    parts = [f"{name} AS ({VIEWS[name].strip()})" for name in _needed(sql)]
    body = sql.strip()
    if parts:
        views = ",\n".join(parts)
        if re.match(r"WITH\b", body):
            body = f"WITH {views},\n" + body[len("WITH"):]
        else:
            body = f"WITH {views}\n{body}"
    return re.sub(r"LOG_TIME\((\w+)\)", r"strftime(\1, '%d/%b/%Y:%H:%M:%S')", body)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or one of the tables, as a DataFrame."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    text = re.sub(
        r"LOG_TIME\((\w+)\)", r"date_format(\1, 'dd/MMM/yyyy:HH:mm:ss')", VIEWS[name]
    )
    used = [t for t in (*TABLES, *VIEWS) if re.search(rf"(FROM|JOIN)\s+{t}\b", text)]
    text = text.replace("{", "{{").replace("}", "}}")
    for t in used:
        text = re.sub(rf"(FROM|JOIN)(\s+){t}\b", rf"\1\2{{{t}}}", text)
    return spark.sql(text, **{t: view(spark, sf_dir, t) for t in used})


def scratch_folder(spark: SparkSession) -> str:
    """A fresh folder in the shared place the cluster names; local runs use a temp folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/tablecheck-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder all executors can reach.")
    return f"{tempfile.mkdtemp(prefix='tablecheck-')}/data"
