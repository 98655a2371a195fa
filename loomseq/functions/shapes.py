"""Return types of the Arrow functions, as objects, so that modules can be imported before there is a session."""

from pyspark.sql import types as T

INT = T.IntegerType()
INTS = T.ArrayType(INT)
INT_ROWS = T.ArrayType(INTS)
BINARY = T.BinaryType()
BYTES = T.ArrayType(BINARY)
RUNS = T.ArrayType(T.StructType().add("n", INT).add("at", INT))
MOVED = T.StructType().add("indices", INTS).add("places", INTS)
INDEX = T.StructType().add("bwt", BINARY).add("sa", INTS).add("end", INT).add("c", INTS).add("occ", BINARY)
COUNTS = T.ArrayType(T.StructType().add("pattern", BINARY).add("n", INT))
PLACES = T.ArrayType(T.StructType().add("pattern", BINARY).add("positions", INTS))
INTERVAL = T.StructType().add("low", INT).add("high", INT)
