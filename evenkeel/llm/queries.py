"""The training-data queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evenkeel.llm.decontaminate import op2_decontamination
from evenkeel.llm.digests import op8_document_fingerprints
from evenkeel.llm.langid import op10_language_id
from evenkeel.llm.lm import op5_lm_scoring
from evenkeel.llm.packing import op4_packing
from evenkeel.llm.secret_scan import op6_secret_scans
from evenkeel.llm.simhash import op7_simhash
from evenkeel.llm.token_counts import op3_token_counts
from evenkeel.llm.token_store import op1_token_store
from evenkeel.llm.toxicity import op9_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_store": op1_token_store,
        "op2_decontamination": op2_decontamination,
        "op3_token_counts": op3_token_counts,
        "op4_packing": op4_packing,
        "op5_lm_scoring": op5_lm_scoring,
        "op6_secret_scans": op6_secret_scans,
        "op7_simhash": op7_simhash,
        "op8_document_fingerprints": op8_document_fingerprints,
        "op9_toxicity": op9_toxicity,
        "op10_language_id": op10_language_id,
    }


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _words_sql(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


#: Every window of every document looked up among the items' windows.
_DECONTAMINATION = f"""
with i as (select item_id::varchar as item, {_words_sql('text')} as w from benchmark),
sized as (select item, w, least(10, len(w)) as n from i where len(w) > 0),
windows as (select distinct item, n, array_to_string(w[s:s + n - 1], ' ') as run from (select item, w, n, unnest(range(1, len(w) - n + 2)) as s from sized)),
runs as (select n, run, list(item) as items from windows group by n, run),
d as (select row_number() over () as r, doc_id, {_words_sql('text')} as w from documents),
places as (select r, n, p, array_to_string(w[p:p + n - 1], ' ') as run from (select r, w, n, unnest(range(1, len(w) - n + 2)) as p from d, (select distinct n from runs))),
hits as (select r, n, p, items from places join runs using (n, run)),
hit_words as (select r, count(distinct x) as n_hit from (select r, unnest(range(p, p + n)) as x from hits) group by r),
hit_items as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, unnest(items) as item from hits) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit_words using (r) left join hit_items using (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": _DECONTAMINATION}
