"""Orrery: a PySpark library for emulator accuracy and experimental design work."""
