"""For spark-submit: run_job.py <job> [options]."""

from cdclake.__main__ import main

if __name__ == "__main__":
    main()
