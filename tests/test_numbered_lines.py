"""Lines numbered over the splits of files."""

import random

from lexloom.sources import readers


def test_lines_of_split_files(spark, tmp_path):
    rng = random.Random(1)
    files = {f"{name}_full_context_only.txt": ["".join(rng.choice("abõ  ") for _ in range(rng.randrange(0, 60))) for _ in range(n)] for name, n in (("maja", 900), ("õu", 1), ("tühi", 0), ("puu", 350))}
    (tmp_path / "in").mkdir()
    for k, (name, lines) in enumerate(files.items()):
        (tmp_path / "in" / name).write_bytes(("\r\n" if k % 2 else "\n").join(lines).encode())
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "997")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = readers.read_contexts(spark, str(tmp_path / "in"))
        got = sorted(map(tuple, df.collect()))
        tasks = spark.read.text(str(tmp_path / "in")).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = [(name.removesuffix("_full_context_only.txt"), i, x) for name, lines in files.items() for i, x in enumerate((x.strip(" ") for x in lines if x.strip(" ")), 1)]
    assert tasks > 20 and got == sorted(want)
