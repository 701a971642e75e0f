"""Size bounds that decide between a one-task plan and a fully split one.

A plan may put one group into one task, or broadcast a table, only after the
size was counted and found under these bounds.
"""

# Rows (or distinct values) one task may hold for a single group.
ONE_TASK_ROWS = 1_000_000

# Rows a table may have to be broadcast to every executor.
BROADCAST_ROWS = 100_000

# Columns per fused aggregate: keeps the generated code inside one method.
FUSED_COLUMNS = 24

# Columns turned into rows by one step.
UNPIVOT_COLUMNS = 12

# Columns up to which every pair of a correlation is its own aggregate.
PAIRWISE_CORR_COLUMNS = 30
