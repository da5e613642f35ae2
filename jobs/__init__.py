"""Runnable jobs over tables of text; see each module's command line."""
