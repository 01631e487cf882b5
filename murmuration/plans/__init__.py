"""Multi-step jobs: staging, the filter loop and its grouped form."""
