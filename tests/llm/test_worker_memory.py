"""What a Python worker holds between tasks; in a process of its own, with a single worker."""

import os
import subprocess
import sys

import pytest

SCRIPT = """
import ctypes, random, re, sys
import pyarrow as pa
import public_tokenizers
from talus.llm import bpe, decontaminate, jaccard_join, quality, secrets
from talus.session import session

s = session("local[1]", spark_sql_shuffle_partitions="1", spark_checkpoint_dir="file://" + sys.argv[1])
s.sparkContext.setLogLevel("ERROR")
r = random.Random(7)
stems = "the of and in house river mountain green yellow paper stone window garden letter summer winter".split()
prose = lambda n: " ".join(r.choice(stems) + r.choice(stems) for _ in range(n))
s.createDataFrame([(i, prose(300), "en", 1) for i in range(1200)], "doc_id long, text string, lang string, n_chars long").write.parquet(sys.argv[1] + "/docs")
docs = s.read.parquet(sys.argv[1] + "/docs")
items = s.createDataFrame([(prose(40),) for _ in range(50)], "text string")

def freed(batches):
    def own():
        with open("/proc/self/smaps_rollup") as f:
            return int(re.search(r"Anonymous:\\s+(\\d+)", f.read())[1]) / 1024
    for _ in batches:
        before = own()
        pa.default_memory_pool().release_unused()
        ctypes.CDLL(None).malloc_trim(0)
        yield pa.RecordBatch.from_arrays([pa.array([before - own()])], names=["mb"])

for name, frame in {
    "decontaminate": lambda: decontaminate.remove(docs, items),
    "jaccard": lambda: jaccard_join.signatures(docs, "doc_id", "text"),
    "quality": lambda: quality.measure(docs),
    "secrets": lambda: secrets.redact(docs),
    "bpe": lambda: bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN),
}.items():
    frame().write.format("noop").mode("overwrite").save()
    print("HELD", name, round(s.range(1).mapInArrow(freed, "mb double").first()[0]))
"""


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="needs Linux")
def test_pipeline_workers_give_back_what_they_freed(tmp_path):
    """MB that an idle worker could still give back after each stage; a worker outlives its stage and meets an executor's limit."""
    pytest.importorskip("public_tokenizers")
    run = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path)], capture_output=True, text=True, timeout=300)
    held = {x.split()[1]: int(x.split()[2]) for x in run.stdout.splitlines() if x.startswith("HELD")}
    assert len(held) == 5, run.stderr[-2000:]
    assert max(held.values()) < 20, held
