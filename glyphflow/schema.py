"""Schemas of results and intermediate tables."""

from pyspark.sql import types as T

POLYGON = T.ArrayType(T.ArrayType(T.IntegerType(), False), False)

#: One recognised region; angle is the 0/180 degree flag of the orientation model.
ITEM = T.StructType(
    [
        T.StructField("text", T.StringType(), False),
        T.StructField("score", T.DoubleType(), False),
        T.StructField("polygon", POLYGON, False),
        T.StructField("angle", T.IntegerType(), False),
    ]
)
#: One image; an image without text has no items, never a null.
RESULT = T.StructType(
    [
        T.StructField("input_path", T.StringType(), False),
        T.StructField("text_count", T.IntegerType(), False),
        T.StructField("items", T.ArrayType(ITEM, False), False),
    ]
)
#: Results that carry the image, for drawing; see IMAGE.
RESULT_WITH_PIXELS = T.StructType([*RESULT.fields, T.StructField("height", T.IntegerType(), False), T.StructField("width", T.IntegerType(), False), T.StructField("data", T.BinaryType(), False)])
IMAGE = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("height", T.IntegerType(), False),
        T.StructField("width", T.IntegerType(), False),
        T.StructField("data", T.BinaryType(), False),  # BGR, rows of height * width * 3
    ]
)
#: A detected quadrilateral: top left, top right, bottom right, bottom left.
BOX = T.StructType([T.StructField("polygon", POLYGON, False), T.StructField("det_score", T.DoubleType(), False)])
