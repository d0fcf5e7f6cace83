"""Multi-step jobs: dataset card, fits, search, batch predict."""
