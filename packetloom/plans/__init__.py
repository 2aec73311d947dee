"""Jobs that combine operators: review queue, pages, reports, exports."""
