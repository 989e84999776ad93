"""The scoring plan on a streaming source gives the batch result."""
import os

from pyspark.sql import functions as F

from segstate.functions.obs import obs_to_str
from segstate.operators.evaluate import score_both
from segstate.plans.catalog import K_FOLDS, SPEC, folded, start_models
from segstate.session import new_work_dir
from segstate.streaming.scoring import score_stream, sequence_stream
from tests.conftest import SF_SMALL


def test_stream_scores_equal_batch(spark):
    fld = folded(spark, SF_SMALL).where(F.col("kfold") == 2)
    models = start_models(folded(spark, SF_SMALL))
    src = os.path.join(new_work_dir(spark, "stream-src"), "seqs")
    fld.select("workitem", "cls", obs_to_str(F.col("obs")).alias("str_obs")).repartition(3).write.parquet(src)
    stream = score_stream(sequence_stream(spark, src, fold=2), models, SPEC, K_FOLDS)
    q = (stream.writeStream.format("memory").queryName("scored_stream").outputMode("append")
         .option("checkpointLocation", os.path.join(new_work_dir(spark, "stream-ckpt"), "c")).start())
    q.processAllAvailable()
    q.stop()
    got = {r.workitem: (r.score1, r.score0) for r in spark.sql("SELECT * FROM scored_stream").collect()}
    want = {r.workitem: (r.score1, r.score0) for r in
            score_both(fld.withColumn("fold", F.col("kfold")), models, SPEC, K_FOLDS).collect()}
    assert got == want and len(got) > 0
