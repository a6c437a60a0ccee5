"""Reading and writing of panels, requests and scored rows."""
