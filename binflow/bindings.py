"""Instrument-shaped views over the driver's tables.

Each text runs unchanged in Spark and DuckDB, except where a second text is
given. ``{name}`` stands for a table or an earlier view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {
    "bins": """
        select bin_id, substr(bin_id, 1, 1) as bin_type,
               concat('/data/', cast(s_suppkey % 5 as string), '/', bin_id, '.adc') as path
        from (select s_suppkey, concat(case when s_suppkey % 2 = 0 then 'D' else 'I' end,
                     lpad(cast(s_suppkey as string), 6, '0')) as bin_id from {supplier}) s""",
    "pids": """
        select event_id as unit,
               concat('D', replace(replace(replace(substr(cast(ts as string), 1, 19), '-', ''), ':', ''), ' ', 'T'),
                      '_IFCB', lpad(cast(user_id % 200 as string), 3, '0')) as pid
        from {events}""",
    # seq orders the rows of a bin by ship date, then order and line: days, 40 bits
    # of order key and 3 bits of line number. No window over the bin is needed.
    "points": """
        select concat(case when l_suppkey % 2 = 0 then 'D' else 'I' end,
                      lpad(cast(l_suppkey as string), 6, '0')) as bin_id,
               cast(datediff(DAY_FROM_EPOCH) as bigint) * 8796093022208 + l_orderkey * 8 + l_linenumber as seq,
               l_orderkey as trigger_id,
               l_extendedprice / 105000e0 * 1.36e0 as x,
               l_quantity / 50e0 as y,
               l_returnflag <> 'N' as has_roi
        from {lineitem}""",
    "gt_features": """
        select concat('S', lpad(cast(l_suppkey as string), 6, '0')) as ifcb_bin, l_partkey as roi_number,
               avg(l_quantity) as area, avg(l_extendedprice) as biovolume,
               avg(l_discount) as solidity, avg(l_tax) as eccentricity
        from {lineitem} group by l_suppkey, l_partkey""",
    "pred_features": """
        select concat('S', lpad(cast(l_suppkey as string), 6, '0')) as sample_id, l_partkey as roi_number,
               avg(l_quantity) * (1e0 + ((l_partkey * 7) % 11 - 5) / 1e2) as area,
               avg(l_extendedprice) + ((l_suppkey * 13) % 101) * 1e1 as biovolume,
               avg(l_discount) + ((l_partkey * 3) % 7) / 1e2 as solidity,
               1e0 - avg(l_tax) as eccentricity
        from {lineitem} where l_partkey % 13 <> 0 group by l_suppkey, l_partkey""",
    "score_sets": """
        select 'bad' as label, concat(case when s_suppkey % 2 = 0 then 'D' else 'I' end, 'B', cast(s_suppkey as string)) as bin_id,
               (s_acctbal + 1000e0) / 11000e0 as score from {supplier}
        union all
        select 'normal', concat(case when c_custkey % 2 = 0 then 'D' else 'I' end, 'N', cast(c_custkey as string)),
               (c_acctbal + 1000e0) / 11000e0 from {customer}""",
    "classes": "select n_nationkey as class_id, n_name as name from {nation}",
    "detections": """
        select concat('img', lpad(cast(user_id as string), 5, '0')) as image_id,
               event_id % 8 as frame, event_id as det_id,
               case event_type when 'view' then 0 when 'click' then 1 when 'purchase' then 2
                               when 'signup' then 3 else 4 end as class_id,
               round(value / 500e0, 6) as conf,
               cast((event_id * 37) % 100 as double) as x1, cast((event_id * 53) % 100 as double) as y1,
               cast((event_id * 37) % 100 + 10 + event_id % 20 as double) as x2,
               cast((event_id * 53) % 100 + 10 + event_id % 15 as double) as y2
        from {events}""",
    "files": """
        select concat('/data/', source, '/', lang, '/', lpad(cast(doc_id as string), 8, '0'),
                      case cast(doc_id % 5 as int) when 0 then '.avi' when 1 then '.jpg' when 2 then '.PNG'
                           when 3 then '.tif' else '.avi' end) as path,
               case when doc_id % 17 = 0 then 0 else n_chars end as size,
               case cast(doc_id % 5 as int) when 0 then '.avi' when 1 then '.jpg' when 2 then '.PNG'
                           when 3 then '.tif' else '.avi' end as suffix,
               doc_id
        from {documents}""",
    "manifest": "select f.path from {files} f join {labels} l on f.doc_id = l.doc_id",
    "status": """
        select user_id as run_id, event_id as unit_id, event_type <> 'error' as ok,
               case when event_type = 'error' then concat('failed: ', cast(event_id as string)) end as error,
               ts as finished_at
        from {events}""",
    "media": "select concat(cast(page_id as string), '.html') as key, html as payload from {pages}",
    "archive_members": """
        select concat('D', lpad(cast(conv_id as string), 6, '0')) as bin_id,
               concat(cast(turn as string), '_', role, '.txt') as member, text as content
        from {conversations}""",
    "task_runs": """
        select user_id as flow_run_id, concat(event_type, '-', cast(event_id % 3 as string)) as task_key,
               event_type as name, min(ts) as started
        from {events} group by user_id, event_type, event_id % 3""",
    "images": """
        select case when doc_id % 10 < 8 then 'train' when doc_id % 10 = 8 then 'val' else 'test' end as split,
               doc_id as stem from {documents} where doc_id % 7 <> 0""",
    "image_labels": """
        select case when doc_id % 10 < 8 then 'train' when doc_id % 10 = 8 then 'val' else 'test' end as split,
               doc_id as stem, quality * 2 + toxic as class_id from {labels}""",
    "pred_masks": """
        select concat('D', cast(label as string)) as sample_id, vec_id as roi_number, 8 as width,
               transform(embedding, e -> cast(e > 0 as int)) as mask from {embeddings}""",
    "gt_masks": """
        select concat('D', cast(label as string)) as sample_id, vec_id as roi_number, 8 as width,
               transform(embedding, e -> cast(e > ((vec_id % 5) - 2) / 1e2 as int)) as mask from {embeddings}""",
    "class_scores": """
        select vec_id, transform(embedding, v -> cast(v as double) * 1e1) as logits from {embeddings}""",
}

# DuckDB texts where the array functions differ.
DUCKDB_VIEWS: dict[str, str] = {
    "pred_masks": """
        select concat('D', cast(label as string)) as sample_id, vec_id as roi_number, 8 as width,
               list_transform(embedding, lambda e: cast(e > 0 as int)) as mask from {embeddings}""",
    "gt_masks": """
        select concat('D', cast(label as string)) as sample_id, vec_id as roi_number, 8 as width,
               list_transform(embedding, lambda e: cast(e > ((vec_id % 5) - 2) / 1e2 as int)) as mask from {embeddings}""",
    "class_scores": """
        select vec_id, list_transform(embedding, lambda v: v::double * 1e1) as logits from {embeddings}""",
}
_DAYS = {"spark": "datediff(cast(l_shipdate as date), date '1970-01-01')", "duckdb": "datediff('day', date '1970-01-01', cast(l_shipdate as date))"}


def view_sql(name: str, engine: str) -> str:
    text = DUCKDB_VIEWS.get(name, VIEWS[name]) if engine == "duckdb" else VIEWS[name]
    return text.replace("datediff(DAY_FROM_EPOCH)", _DAYS[engine])


def needs(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"{(\w+)}", text)))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a view over base tables, as a DataFrame."""
    if name in BASE_TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = view_sql(name, "spark")
    return spark.sql(text, **{other: load(spark, sf_dir, other) for other in needs(text)})


def duckdb_sql(body: str) -> str:
    """Query text with the views it uses put before it as common table expressions."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in needs(text):
            if name in VIEWS and name not in order:
                visit(view_sql(name, "duckdb"))
                order.append(name)

    visit(body)
    plain = lambda text: re.sub(r"{(\w+)}", r"\1", text)
    views = ",\n".join(f"{name} as ({plain(view_sql(name, 'duckdb'))})" for name in order)
    body = plain(body).strip()
    if not views:
        return body
    if body.lower().startswith("with recursive "):
        return f"with recursive {views},\n{body[len('with recursive '):]}"
    if body.lower().startswith("with "):
        return f"with {views},\n{body[len('with '):]}"
    return f"with {views}\n{body}"
