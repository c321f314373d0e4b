"""framelore: a PySpark analytics engine for time-stamped, box-annotated observations."""
