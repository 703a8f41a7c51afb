"""Exam-question analytics as Spark DataFrame jobs."""
