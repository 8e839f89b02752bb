"""Byte-level reading and writing of PDF files, without Spark: what no column expression can say."""
