"""Queries whose workers have no copy of the package: the driver alone can import it. And long texts in bounded memory."""

import os
import subprocess
import sys
import textwrap


ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

RUN = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.driver.memory", "2g").config("spark.sql.shuffle.partitions", "2").config("spark.sql.session.timeZone", "UTC").getOrCreate()
spark.sparkContext.setLogLevel("OFF")

def importable(_):
    try:
        import claimweave
        return [1]
    except ModuleNotFoundError:
        return [0]

assert spark.sparkContext.parallelize([0], 1).mapPartitions(importable).collect() == [0]
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
for name in {names!r}:
    queries = entry.queries()
    print(name, queries[name](spark, "/root/testdata/sf0.001").count(), flush=True)
"""

NAMES = ["op2_source_mixing", "op3_quality_classifier", "op4_licence_scan", "op5_packing", "op7_minhash_near_dedup", "op8_embedding_near_dedup", "op9_language_id", "op10_token_counts", "op11_conversation_repair", "op12_toxicity", "op13_prefix_trie", "pipeline"]


def test_workers_without_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET", "SPARK_HOME")}
    if tokens := [p for p in os.environ.get("PYTHONPATH", "").split(":") if p and not os.path.samefile(p, ROOT)]:
        env["PYTHONPATH"] = ":".join(tokens)
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(RUN).format(root=ROOT, names=NAMES)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=500)
    assert done.returncode == 0, done.stderr[-3000:]
    counts = dict(line.split() for line in done.stdout.splitlines() if line.startswith(("op", "pipeline")))
    assert counts.keys() == set(NAMES) and all(int(n) > 0 for n in counts.values())


LONG = """
import random, resource, sys
sys.path.insert(0, {root!r})
import numpy as np
from claimweave.llm import langid, quality, toxicity
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
r = random.Random(1)
some = [''.join(r.choices('abcdefgh', k=5)) for _ in range(5000)]
text = ' '.join(r.choices(some, k=10_000_000))
run = 'ab' * 500_000
model = quality.Model({{w: k for k, w in enumerate(some[:100])}}, np.ones((100 + quality.OTHERS, quality.WIDTH), np.float32), np.ones((quality.SHAPES + 2, quality.WIDTH)))
assert model.pooled(quality.Reader(model.vocabulary), text).shape == (2 * quality.WIDTH,)
model.pooled(quality.Reader(model.vocabulary), run)
toxicity.Reader(np.arange(0, toxicity.BUCKETS, 7))(text)
languages = langid.trained({{f'l{{k}}': langid.Counter({{'\\x02\\x02\\x02a': 3, '\\x02\\x02ab': 2, 'abab': k + 1, 'baba': 5, 'bab\\x03': 1}}) for k in range(300)}})
entropy, length = langid.Scorer(languages)([text, run])
assert length[0] == 6 * 10_000_000 and length[1] == 1_000_001
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) // 1024)
"""


def test_ten_million_words_within_a_gigabyte():
    done = subprocess.run([sys.executable, "-c", LONG.format(root=ROOT)], capture_output=True, text=True, timeout=400)
    assert done.returncode == 0, done.stderr[-3000:]
    assert int(done.stdout) < 1024, f"{done.stdout} MB"
