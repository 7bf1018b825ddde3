"""Small hand-made inputs."""

EDGE_LINES = ["# comment", "10 20", "20 10", "20\t30 extra", "30 30", "40 40", "bad line", "7", "x 9", "", "10 20", "  30   10 ", "50 -3", "-3 50"]


def edge_lines(spark):
    return spark.createDataFrame([(x,) for x in EDGE_LINES], "value string")


def lines(spark, rows):
    return spark.createDataFrame(rows, "file_ord int, line_no long, value string")
