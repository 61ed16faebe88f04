"""patchloom: change-review and text-corpus analytics on PySpark."""

import os

# One thread of linear algebra a process: Spark runs a process for each core already, and threads were seen to hang in a driver.
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
