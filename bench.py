"""Time the headline queries: prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). The stand-in files
and the tables of earlier stages are written first (``prepare_sec``, not part of the value); each
query then reads what it depends on and is executed in full with the noop sink. Queries that build a
stage table compute it anew. Arguments, if any, name the queries to run.
"""

from __future__ import annotations

import json
import os
import sys
import time

from catalogue import landing
from catalogue.queries import queries
from contraluz.session import build_session
from catalogue.standin import Standin

HEADLINE = [
    "normalize_name",
    "parse_money_br",
    "contracts_with_period",
    "zip_csv_scan",
    "encoding_repair",
    "nested_json_contracts",
    "sanctions_unified",
    "contracts_latest",
    "universe",
    "partners_in_universe",
    "links_high",
    "links_medium",
    "links",
    "risk_degrees",
    "company_risk",
    "successor_candidates",
    "radar_summary",
    "statistics",
    "agencies_ranking",
    "agency_suppliers",
    "best_name",
    "company_search_name",
    "company_sheet_registration",
    "company_sheet_contracts",
    "audit_sheet",
    "graph_depth2_edges",
    "graph_nodes",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "contraluz-bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    timings: dict[str, float] = {}
    inputs = Standin(spark, folder)
    inputs.table("region").count()
    started = time.perf_counter()
    inputs.names(), inputs.held(), inputs.company_risk(), inputs.risk(), inputs.universe()
    landing.purchases_csv(inputs), landing.purchases_zip(inputs), landing.contract_pages(inputs)
    prepare = round(time.perf_counter() - started, 3)
    registry = queries()
    for name in sys.argv[1:] or HEADLINE:
        started = time.perf_counter()
        registry[name](spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - started, 3)
        print(name, timings[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "prepare_sec": prepare,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
