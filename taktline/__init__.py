"""Public-transport timetable and operator-statistics analytics on PySpark."""
