"""Session settings that the library's jobs should run with."""

#: The JVM compiles no method beyond 8000 bytes of code and interprets it row by row; with the limit, Spark splits
#: the expressions of such a stage over smaller methods instead (parsers and audit merge: up to twice as fast).
SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.codegen.hugeMethodLimit": "8000"}
