"""Held-out precision, recall and area under the curve of op1 on a folder of tables: python tests/llm/measure_toxicity.py /root/testdata/sf0.1"""

import os
import sys

import numpy as np
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from barsmith.llm import toxicity  # noqa: E402
from barsmith.llm.common import read_table  # noqa: E402


def main(folder: str) -> None:
    spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    labels = read_table(spark, folder, "labels")
    rows = toxicity.score_toxicity(read_table(spark, folder, "documents"), labels).where("held_out").join(labels.where("toxic IS NOT NULL").select("doc_id", "toxic"), "doc_id").select("score", "predicted", "toxic").collect()
    score, predicted, toxic = (np.array([r[i] for r in rows]) for i in range(3))
    hit = ((predicted == 1) & (toxic == 1)).sum()
    one, zero = score[toxic == 1][:, None], score[toxic == 0][None]
    print({"rows": len(rows), "toxic": int(toxic.sum()), "precision": round(hit / max(1, predicted.sum()), 3), "recall": round(hit / max(1, toxic.sum()), 3), "area": round(float(((one > zero) + 0.5 * (one == zero)).mean()), 4)})


if __name__ == "__main__":
    main(sys.argv[1])
