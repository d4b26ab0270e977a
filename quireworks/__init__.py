"""Quireworks: page, record and corpus operators expressed as Spark jobs."""
