"""Operators of a training-data pipeline; nothing else in featloom imports them."""
