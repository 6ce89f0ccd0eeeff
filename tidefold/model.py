"""Schemas, keys and constants of the audit's tables."""

from __future__ import annotations

from pyspark.sql import types as T

#: Key of a fold's train, validation and test rows.
CELL = ("test_subject", "test_trial", "task", "fold")
#: Key of one unfolded dataset.
DATASET = ("test_subject", "test_trial", "task")
#: Key of a session.
SESSION = ("subject", "trial")

# Fixed values
FS = 2048.0
WINDOW_SAMPLES = 2048
Q_POSITIVE = (1.0, 2.0, 3.0, 5.0)
Q_ALL = (-5.0, -3.0, -2.0, -1.0, 0.0, 1.0, 2.0, 3.0, 5.0)
REL_FLOOR = 1e-3
EPS = 2.220446049250313e-16
QUOTA = 120
MARGIN = 0.02
RESAMPLES, RHO_RESAMPLES = 10_000, 2_000
LAG_CAP, LEAST_PAIRS = 600, 20
STFT = {"window": 512, "overlap": 0.75, "max_hz": 150.0}
PLATEAU = 8


# Names and types of published tables' columns


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


_I, _L, _D, _S = T.IntegerType(), T.LongType(), T.DoubleType(), T.StringType()

FOLD_INDEX = _struct(
    split=_S, test_subject=_I, test_trial=_I, task=_S, fold=_I, role=_S, src_subject=_I, src_trial=_I, item=_I, base_index=_L, window_from=_L, window_to=_L, label=_I
)
DECODE_RESULT = _struct(
    split=_S, test_subject=_I, test_trial=_I, task=_S, fold=_I, rung=_S, n_train=_I, n_test=_I, n_features=_I, test_auroc=_D, train_auroc=_D, n_excluded_plateau=_I
)
CELLS = _struct(model=_S, split=_S, subject=_I, trial=_I, task=_S, auroc=_D)
ELECTRODE_MEANS = _struct(electrode=_S, mean_auroc=_D)
MANIFEST = T.StructType(
    [T.StructField(k, _S) for k in ("name", "url", "sha256", "downloaded_utc")] + [T.StructField("bytes", _L), T.StructField("extracted", T.BooleanType()), T.StructField("members", T.ArrayType(_S))]
)
LEADERBOARD = T.StructType([T.StructField("evaluation_results", T.MapType(_S, T.StructType([T.StructField("population", T.StructType([T.StructField("one_second_after_onset", T.StructType([T.StructField("folds", T.ArrayType(T.StructType([T.StructField("test_roc_auc", _D)])))]))]))])))])
