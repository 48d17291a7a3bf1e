"""Cross-sectional, time-series and cleaning operators."""
