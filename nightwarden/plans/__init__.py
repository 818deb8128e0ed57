"""End-to-end detection, flow, alert-store and learning plans."""
