"""Training, calibration and scoring with MLlib."""
