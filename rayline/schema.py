"""Types of the records that operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T

POINT = T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])
ANGLES = T.StructType([T.StructField("left", T.DoubleType()), T.StructField("right", T.DoubleType())])
CASE = T.StructType(
    [
        T.StructField("row_number", T.IntegerType(), False),
        T.StructField("previous", POINT),
        T.StructField("current", POINT),
        T.StructField("current_road", T.StringType()),
        T.StructField("target_road", T.StringType()),
        T.StructField("city", T.StringType()),
    ]
)
#: Outcomes of an evaluated case.
PASS, FAIL, ERROR = "PASS", "FAIL", "ERROR"
#: Lookup tables: the raster around a point, the snap response of a point, the response for a place.
TILES = "point_key string, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
SNAPS = "point_key string, body string"
PLACES = "place_id string, body string"
