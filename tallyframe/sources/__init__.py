from .catalogue import list_files, load_info
from .csv import read_csv
from .sinks import write_table
from .workbooks import read_workbooks, sheet_names, sheet_rows, sheet_table, workbook_errors

__all__ = [
    "list_files",
    "load_info",
    "read_csv",
    "read_workbooks",
    "sheet_names",
    "sheet_rows",
    "sheet_table",
    "workbook_errors",
    "write_table",
]
