"""Statistical plans: calibration, evaluation, inference."""
