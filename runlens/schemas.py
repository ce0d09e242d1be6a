"""Column types of the tables the operators exchange."""

PODS = ("pod_id BIGINT, name STRING, labels MAP<STRING,STRING>, phase STRING, ip STRING, "
        "node_name STRING, run_id BIGINT")
RUNS = ("run_id BIGINT, name STRING, created_at TIMESTAMP, finished_at TIMESTAMP, state STRING, "
        "job_id STRING, job_metadata STRING, cpu_limit STRING, num_workers INT, "
        "network_bandwidth_limit INT")
METRICS = ("metric_id BIGINT, name STRING, date TIMESTAMP, value STRING, metadata STRING, "
           "cumulative BOOLEAN, pod_id BIGINT, run_id BIGINT")
EVENTS = ("pod_name STRING, run_id STRING, name STRING, date STRING, value STRING, "
          "cumulative STRING, metadata STRING, rank INT, epoch STRING")
SNAPSHOTS = ("pods ARRAY<STRUCT<podRef: STRUCT<name: STRING>, "
             "containers: ARRAY<STRUCT<cpu: STRUCT<time: STRING, usageNanoCores: BIGINT>, "
             "memory: STRUCT<time: STRING, usageBytes: BIGINT>>>, "
             "network: STRUCT<time: STRING, rxBytes: BIGINT, txBytes: BIGINT>>>")
SAMPLES = "sample_id BIGINT, features ARRAY<DOUBLE>, label DOUBLE, split STRING"

# Widths of the text columns, run states, and the registered datasets.
WIDTHS = {"name": 50, "value": 100}
RUN_STATES = ("initialized", "started", "failed", "finished")
DATASETS = [
    ("webspam", 350000, 16609143, True),
    ("epsilon-train", 400000, 2000, False),
    ("duke-train", 44, 7129, True),
    ("australian-train", 690, 14, False),
    ("rcv1-train", 677399, 47236, True),
    ("synthetic-dense", 10000, 100, False),
]
