"""Building blocks: filters, joins, child summaries, ranking, currency conversion and table maintenance."""
