"""Table types of the data model. A marker row's dosage array is in the order of sample_idx."""

from pyspark.sql import types as T

_F = T.StructField


def _s(**columns: T.DataType) -> T.StructType:
    return T.StructType([_F(name, kind) for name, kind in columns.items()])


S, I, L, D, Y = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.ByteType()

MARKER_MAP = _s(marker_id=S, chr=I, pos=L, ref=S, alt=S, maf=D, rsid=S, block_id=S, local_row=I)
GENOTYPE = _s(marker_id=S, chr=I, pos=L, dosage=T.ArrayType(Y))
PHENOTYPE = _s(sample_id=S, sample_idx=I, y=D)
SAMPLE_PANEL = _s(sample=S, super_pop=S)
KINSHIP = _s(i=I, j=I, k=D)
COVARIATES = _s(sample_idx=I, c=T.ArrayType(D))
GWAS_RESULT = _s(marker_id=S, chr=I, pos=L, beta=D, t=D, p=D)
IMPORTANCE = _s(marker_id=S, chr=I, pos=L, rf_mean_importance=D, gb_mean_importance=D, rf_selection_folds=I, gb_selection_folds=I, rf_rank=I, gb_rank=I)
OOF = _s(sample_id=S, y=D, rf=D, gb=D, pc_only=D)
CAUSAL = _s(marker_id=S, chr=I, pos=L, maf=D, weight=D)
REGION = _s(region_id=S, chr=I, lo=L, hi=L)
MANIFEST = _s(chr=I, block=I, markers=L, path=S)
